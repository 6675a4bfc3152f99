"""Plumbline: measurement and code-quality analytics on Spark DataFrames."""
