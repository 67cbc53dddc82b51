"""factlake: analytical result sets as snapshot-logged Parquet, on plain Spark DataFrames."""
