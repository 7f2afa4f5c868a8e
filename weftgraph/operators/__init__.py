"""Graph operators as functions of DataFrames."""
