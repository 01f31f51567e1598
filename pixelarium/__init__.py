"""Spark-first analytics over geo-referenced embedding rasters."""

__version__ = "0.1.0"
