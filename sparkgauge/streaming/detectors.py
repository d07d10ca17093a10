"""Row-wise detectors on streams. Bounds come from a table of the past and stand in the plan; beyond the batch engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import anomalies as A


def zscore_stream(stream: DataFrame, history: DataFrame, columns: Sequence[str], threshold: float = A.Z_THRESHOLD) -> DataFrame:
    """Rows of a stream beyond the bounds of ``history`` in any column, with the columns that flag them."""
    bounds = A.zscore_bounds(history, columns, threshold)
    which = F.array_compact(F.array(*[F.when(A.outside(stream, n, b), F.lit(n)) for n, b in bounds.items()]))
    return stream.withColumn("flagged_by", which).where(F.size("flagged_by") > 0)


def missing_stream(stream: DataFrame, threshold: int = 1) -> DataFrame:
    return A.missing_rows(stream, threshold)


def windowed_counts(flagged: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Flagged rows by window of event time; rows later than ``late`` are left out."""
    return flagged.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"))
