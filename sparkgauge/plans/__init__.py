"""Whole runs: configuration, per-table analysis, reports, benchmarks and the command line."""
