"""gridloom: labelled numeric matrices and the networks derived from them, on Spark DataFrames."""

__version__ = "0.1.0"
