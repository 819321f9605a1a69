"""Relational operators over DataFrames, as functions."""
