"""A PySpark-native engine for semantic retrieval over text and source-code collections."""

__version__ = "0.1.0"
