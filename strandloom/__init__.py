"""Molecular-structure analytics on Spark DataFrames."""
