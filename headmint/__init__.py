"""headmint: message-header analytics on Spark DataFrames."""
