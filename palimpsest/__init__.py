"""Palimpsest: a Spark-native engine for change-history analytics."""
