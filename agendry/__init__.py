"""Event-catalogue engine on Spark DataFrames."""
