"""Spark-native retrieval analytics: relations, text and vector operators, streaming."""
