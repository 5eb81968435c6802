"""Relational, graph, retrieval and evaluation operators: DataFrames in, DataFrame out."""
