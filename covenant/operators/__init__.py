"""Operators on DataFrames that several queries share."""
