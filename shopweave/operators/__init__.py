"""Operators: functions from DataFrames to DataFrames, for all stores at once."""
