"""Spark-native analytics over an embedding-and-graph memory store."""
