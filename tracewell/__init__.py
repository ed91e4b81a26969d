"""Spark-native analytics over versioned code graphs, bug reports and issue events."""

__version__ = "0.1.0"
