"""Tone-evaluation analytics on Spark DataFrames."""
