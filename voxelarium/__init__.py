"""Volumetric image analytics on Spark DataFrames."""
