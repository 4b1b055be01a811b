"""Experiment analytics on Spark DataFrames."""
