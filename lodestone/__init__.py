"""Spark-native retrieval analytics and training-data operators."""
