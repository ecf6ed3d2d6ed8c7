"""Validation of DataFrames."""
