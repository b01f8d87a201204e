"""Message-flow analytics on Spark: logs of subject-addressed messages as DataFrames."""
