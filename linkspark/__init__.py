"""Spark-native record linkage and training-data analytics."""
