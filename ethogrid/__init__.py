"""Trajectory, interval and training-data analytics on Spark DataFrames."""
