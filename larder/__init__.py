"""Larder: a Spark-first analytics engine for food-composition records and text corpora."""
