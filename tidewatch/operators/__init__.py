"""Operators over long-form DataFrames."""
