"""tidemark: event-time sequence analytics on Spark DataFrames."""
