"""Spark-native literature mining, streaming match and training-data operators."""
