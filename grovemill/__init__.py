"""Decision-tree ensembles on Spark DataFrames: encode, discretize, grow, boost, score."""
