"""Spark-native exemplar retrieval and SQL-workload analytics."""
