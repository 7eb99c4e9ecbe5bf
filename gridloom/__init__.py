"""Spark-native analytics over fleets of repositories and over text corpora."""
