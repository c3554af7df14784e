"""Spark-native dataset curation, evaluation and training-data engine."""
