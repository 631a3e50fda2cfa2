"""Parley: conversation analytics on Spark DataFrames."""
