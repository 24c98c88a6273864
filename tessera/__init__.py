"""Relational, vector and graph analytics on Spark DataFrames."""
