"""Batch scoring of predicted trajectories of time-stamped points, on Spark DataFrames."""
