"""Spark-native analytics for earthquake catalogs and training-data corpora."""
