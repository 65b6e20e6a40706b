"""Spark-first analytics over purchase history and text corpora."""
