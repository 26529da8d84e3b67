"""Elective-care waiting-list analytics on Spark DataFrames."""
