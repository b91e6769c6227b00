"""Millrace: a Spark-first analytics and table-load engine."""

__version__ = "0.1.0"
