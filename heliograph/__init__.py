"""Heliograph: a Spark-native engine for curating media catalogues and training data."""
