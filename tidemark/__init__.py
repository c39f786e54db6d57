"""Point-in-time analytics over (symbol, date) panels, on Spark DataFrames."""
