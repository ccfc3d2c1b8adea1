"""Spark-native immune-repertoire analytics."""
