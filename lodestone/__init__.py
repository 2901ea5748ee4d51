"""Lodestone: knowledge-retrieval and corpus analytics on Spark DataFrames."""
