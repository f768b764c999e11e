"""Sampled text corpora and telemetry as Spark DataFrames."""
