"""Firm-formation analytics on Spark DataFrames."""
