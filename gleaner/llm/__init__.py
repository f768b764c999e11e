"""Operators of a training-data pipeline. Nothing outside of this folder imports it."""
