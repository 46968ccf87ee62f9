"""Proofing of large collections of paged documents on Spark DataFrames."""
