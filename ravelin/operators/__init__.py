"""Operators over DataFrames: retrieval, fusion, segmentation, layout, knowledge base."""
