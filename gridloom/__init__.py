"""Spreadsheet-style analytics on Spark DataFrames."""
