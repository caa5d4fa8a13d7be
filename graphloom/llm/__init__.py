"""Operators for large training-data pipelines, each a Spark job of its own."""
