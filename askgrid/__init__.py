"""Spark-first analytics over messy tabular data."""
