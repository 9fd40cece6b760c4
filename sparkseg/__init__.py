"""Change points, states and transitions of time series, on Spark DataFrames."""
