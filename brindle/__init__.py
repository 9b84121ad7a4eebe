"""Spark-native analytics over code-quality facts, revisions and text corpora."""

__version__ = "0.1.0"
