"""Spark-native document indexing, search and corpus preparation."""
