"""voxelspark: dense 3-D scientific volumes as Spark DataFrames."""

__version__ = "0.1.0"
