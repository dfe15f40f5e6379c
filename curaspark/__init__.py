"""Spark-native analytics for curating object-detection datasets."""
