"""Analytics of gridded time series, and corpus operators, on Spark DataFrames."""
