"""Event, voxel and track analytics on Spark DataFrames."""
