"""Quire: document structuring and review for whole corpora on Spark DataFrames."""
