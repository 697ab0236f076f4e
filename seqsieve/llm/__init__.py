"""Operators of a training-data pipeline; the rest of the library doesn't import them."""
