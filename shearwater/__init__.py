"""Spark-first analytics for semi-structured public listings."""
