"""Tablewright: dataset intelligence and model building as Spark jobs."""

__version__ = "0.1.0"
