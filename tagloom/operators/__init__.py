"""Index and lookup operators: functions from DataFrames to DataFrames."""
