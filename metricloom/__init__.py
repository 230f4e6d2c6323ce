"""Spark-native operational analytics over event, metric, segment, access and log tables."""
