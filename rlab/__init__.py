"""rlab: retrieval evaluation, transfer analysis and corpus preparation on Spark DataFrames."""
