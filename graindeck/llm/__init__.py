"""Operators of a large-scale training-data pipeline. Nothing else in graindeck imports this package."""
