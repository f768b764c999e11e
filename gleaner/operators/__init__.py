"""Operators: plain DataFrame to DataFrame functions."""
