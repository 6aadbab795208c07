"""Spark-native analytics for document collections and the question-answering systems built on them."""
