"""Spark-native evaluation and analytics: queries, result comparison, paired statistics, streams."""
