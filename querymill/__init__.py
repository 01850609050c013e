"""Counting-query workloads and private synthetic tables on Spark."""

__version__ = "0.1.0"
