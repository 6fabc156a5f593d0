"""Multi-label data profiling and stratified splitting on Spark DataFrames."""
