"""Metered-cost and spend-commitment analytics on Spark DataFrames."""
