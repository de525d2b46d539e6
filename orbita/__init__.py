"""Spark-native analytics over implicit permutation graphs and search archives."""
