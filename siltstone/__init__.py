"""siltstone: a Spark-native toolkit for data quality, text and signal analytics."""

__version__ = "0.1.0"
