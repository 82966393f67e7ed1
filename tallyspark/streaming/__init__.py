"""Structured Streaming forms of the period sums, outlier flags and table profiles."""
