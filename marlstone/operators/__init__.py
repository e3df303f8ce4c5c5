"""Query operators: functions from DataFrames to DataFrames, and the builder over them."""
