"""Market-coverage analytics over a national company register, on Spark DataFrames."""
