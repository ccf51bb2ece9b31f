"""Spark-native product-catalog quality operators and training-data operators."""
