"""Sequence, join, aggregation, matching and scoring operators over DataFrames."""
