"""Relational, vector, graph and text operators: DataFrames in, DataFrame out."""
