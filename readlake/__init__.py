"""readlake: sequencing-read data as ordinary Spark DataFrames."""
