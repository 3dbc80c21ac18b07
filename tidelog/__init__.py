"""tidelog: a change-data engine on Spark DataFrames."""
