"""Registered queries, and the lifecycles from files to an index and from a question to contexts."""
