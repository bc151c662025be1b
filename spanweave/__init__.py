"""Interval, junction-graph and path-assembly jobs on Spark DataFrames."""
