"""Spark-native semantic retrieval and grounded-generation data engine."""
