"""Spark-first short-text search, ranking and search-analytics engine."""
