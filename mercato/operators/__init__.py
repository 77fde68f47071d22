"""Reusable DataFrame operators: ranking, time series, integrity checks."""
