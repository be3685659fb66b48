"""Transforms over DataFrames."""
