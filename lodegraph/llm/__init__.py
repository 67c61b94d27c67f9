"""Operators of a training-data pipeline; nothing else in lodegraph imports this package."""
