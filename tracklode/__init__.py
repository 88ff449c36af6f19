"""Analytics over multi-stream, time-stamped sensor recordings, on Spark DataFrames."""
