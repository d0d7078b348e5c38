"""Search, index and metric operators over vector DataFrames."""
