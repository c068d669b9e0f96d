"""Page-record quality and reconciliation on Spark DataFrames."""
