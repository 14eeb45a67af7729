"""Operators: functions from DataFrames to DataFrames, meant for ``df.transform``."""
