"""Differentially private statistical releases, planned as Spark DataFrames."""
