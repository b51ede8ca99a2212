"""Operators over execution records, counters, locks and inventory: functions from DataFrames to a DataFrame."""
