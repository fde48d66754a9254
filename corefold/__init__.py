"""Mention, event and coreference tables on Spark DataFrames."""
