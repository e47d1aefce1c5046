"""Spark-native corpus curation and language-model analytics."""

__version__ = "0.1.0"
