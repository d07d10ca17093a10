"""Operators from DataFrame to DataFrame: anomalies, profiles, types, mapping, schemas, degradation and evaluation."""
