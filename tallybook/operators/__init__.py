"""Operators: plain functions from a ``Tables`` object (and an as-of date) to DataFrames."""
