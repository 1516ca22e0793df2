"""Rule-style analytics and corpus preparation on Spark DataFrames."""
