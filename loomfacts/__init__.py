"""Fact tables as DataFrames: a Spark-first engine for deriving, querying and reporting facts."""
