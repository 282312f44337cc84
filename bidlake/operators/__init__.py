"""Operators of the procurement domain: DataFrame in, DataFrame out."""
