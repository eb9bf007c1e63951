"""termloom: ranked full-text search and index upkeep on Spark DataFrames."""
