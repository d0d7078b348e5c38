"""Nearest-neighbour search and distance-comparison pruning over vectors kept in DataFrames."""
