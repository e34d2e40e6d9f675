"""litsieve: literature-scale evidence processing on Spark DataFrames."""
