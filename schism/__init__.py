"""Spark-native analysis of polarisation in collections of text."""
