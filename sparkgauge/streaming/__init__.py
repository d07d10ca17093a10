"""Structured Streaming forms of row-wise detectors."""
