"""Spark-native operators for building, searching, testing and auditing text corpora."""
