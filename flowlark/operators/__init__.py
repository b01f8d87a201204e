"""Operators over message logs, as builders of DataFrames."""
