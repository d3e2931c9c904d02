"""Spark-native vector search and similarity-graph clustering."""

__version__ = "0.1.0"
