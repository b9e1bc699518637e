"""A Spark-native engine for rule-driven scoring of document tables."""

__version__ = "0.1.0"
