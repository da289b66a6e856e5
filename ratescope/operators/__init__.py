"""Operators: functions from DataFrames to DataFrames, all lazy unless their text says otherwise."""
