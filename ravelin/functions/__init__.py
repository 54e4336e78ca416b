"""Scalar functions as Catalyst expressions, and interfaces for models."""
