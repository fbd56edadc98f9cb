"""Overlapping-community discovery and scoring on Spark DataFrames."""
