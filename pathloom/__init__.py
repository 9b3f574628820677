"""pathloom: program-graph and sequence n-gram analytics on Spark DataFrames."""

__version__ = "0.1.0"
