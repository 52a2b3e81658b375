"""Galena: labelled-embedding galleries as Spark DataFrames."""
