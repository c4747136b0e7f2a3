"""Spark-first sequence-alignment and evidence analytics."""

__version__ = "0.1.0"
