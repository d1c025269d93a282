"""Analytics over grouped candidate ensembles, on Spark DataFrames."""
