"""Operators: functions from DataFrames to a DataFrame, over batches of queries."""
