"""Lexical and text-sequence analytics on Spark DataFrames."""
