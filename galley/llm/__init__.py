"""Operators of a training-data pipeline: scoring, filtering, joining, packing, searching."""
