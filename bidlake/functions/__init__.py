"""Scalar functions of the procurement domain as column expressions."""
