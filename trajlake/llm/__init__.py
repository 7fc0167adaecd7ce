"""Operators of a training-data pipeline over a documents table."""
