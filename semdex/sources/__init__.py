"""Readers of files and configuration, and the index's tables."""
