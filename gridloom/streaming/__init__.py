"""Live feeds and watches as streaming DataFrames."""
