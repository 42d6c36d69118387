"""Operators of the edit engine, DataFrame in and DataFrame out."""
