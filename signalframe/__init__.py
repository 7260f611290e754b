"""Multichannel physiological signal corpora as Spark DataFrames."""
