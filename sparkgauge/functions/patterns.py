"""Patterns of semantic types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semantic types in order of priority, with the patterns of their trimmed values.
SEMANTIC_TYPES = {
    "Email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "URL": r"(?i)^(https?://|www\.)",
    "UUID": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$",
    "Date": r"^\d{4}-\d{2}-\d{2}$",
    "DateTime": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?(?:[+-]\d{2}:?\d{2})?$",
    "Price": r"^[$€£]?\s?\d+[.,]?\d*$",
    "Phone": r"^\+?\d{1,3}?[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}$",
    "IP Address": r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",
    "Credit Card": r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11})$",
}
#: The patterns that serve as hints on a column's values.
HINTS = ("Email", "URL", "UUID", "Date", "DateTime", "Price", "Phone")


def matches(value: Column, kind: str) -> Column:
    return F.trim(value).rlike(SEMANTIC_TYPES[kind])
