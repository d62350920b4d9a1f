"""tidefold: corpus, event-stream and sequence operators on Spark DataFrames."""
