"""Skein: a Spark-native engine for document knowledge: text, graph, vectors, evaluation."""
