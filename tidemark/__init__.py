"""Tidemark: declarative data quality, replay, history and governance on Spark DataFrames."""
