"""Symbolic models, rules, series features and their evaluation on Spark DataFrames."""
