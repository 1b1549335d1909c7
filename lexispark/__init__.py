"""Spark-native analysis of the spelling quality of large text collections."""
