"""strandframe: sequence, structure, statistics and taxonomy operators on Spark DataFrames."""

__version__ = "0.1.0"
