"""Lodestone: semantic retrieval over note collections, built on Spark DataFrames."""
