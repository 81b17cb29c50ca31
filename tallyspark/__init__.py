"""Usage analytics for assistant logs and quota readings, as Spark DataFrames."""
