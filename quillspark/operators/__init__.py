"""Operators on DataFrames of files and pages."""
