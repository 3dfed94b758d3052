"""Earthquake-catalog analytics as Spark DataFrame and Structured Streaming jobs."""
