"""Spark-native preparation of contrastive training data and text corpora."""
