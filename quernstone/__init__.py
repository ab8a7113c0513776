"""A Spark-native engine for strictly typed, single-table analytical queries."""

__version__ = "0.1.0"
