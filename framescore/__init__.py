"""Spark-first evaluation of event-argument extraction."""
