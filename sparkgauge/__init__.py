"""Spark-native data quality, schema and field-mapping engine."""
