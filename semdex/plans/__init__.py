"""Whole plans: indexing, searching an index, and the registered queries."""
