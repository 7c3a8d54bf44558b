"""The operators: functions from tables to a DataFrame."""
