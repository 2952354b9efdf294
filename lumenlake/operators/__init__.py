"""Relational operators of the catalogue, each a function of DataFrames."""
