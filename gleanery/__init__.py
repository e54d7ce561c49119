"""Spark-native discovery engine for source repositories and text corpora."""
