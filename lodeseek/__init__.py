"""lodeseek: document search and analytics as Spark DataFrames."""
