"""Relational operators of the retrieval engine, each a function of DataFrames."""
