"""Tributary: content analytics on Spark DataFrames, SQL and Structured Streaming."""
