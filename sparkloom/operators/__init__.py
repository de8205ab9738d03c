"""Operators over the model's tables; each takes and returns DataFrames."""
