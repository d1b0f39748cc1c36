"""Spark-native retrieval, record-merging and data-preparation engine."""

__version__ = "0.1.0"
