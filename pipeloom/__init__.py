"""Pipe-style analytics on Spark DataFrames."""
