"""Stages from DataFrames to DataFrames."""
