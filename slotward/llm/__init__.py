"""Operators of a training-data pipeline: DataFrames of texts in, DataFrames of decisions out."""
