"""Spark-native engine for code property graphs, line-level text search and change planning."""
