"""Joins, windows, aggregations, reports and set operations over DataFrames."""
