"""First rows and first values of tables, without a sort where rows are numbered, and for all columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .types import ROW_INDEX, q

#: Rows that are looked through first for each value sought, how many times as many next, and how many a top-k may hold.
REACH, GROWTH, MOST = 4, 16, 1 << 17


def head(df: DataFrame, rows: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``rows`` rows: by the row index, which is a filter; by other columns, a top-k; or else in the order of the scan."""
    if order_by and list(order_by) == [ROW_INDEX]:
        return df.where(q(ROW_INDEX) < rows)
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def first_values(df: DataFrame, names: Sequence[str], rows: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, value): the first ``rows`` non-null values of each column, as text.

    One look at the table's head counts the values of all columns; only columns that need more, as they begin with nulls, are
    sought further, in heads that grow ``GROWTH``-fold, or by themselves where rows aren't numbered and a head would hold
    more than ``MOST`` rows.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column string, value string")
    numbered = bool(order_by) and list(order_by) == [ROW_INDEX]
    reach, left, size, alone = {}, list(names), REACH * rows, []
    while left:
        if size > MOST and not numbered:
            alone = left
            break
        found = head(df, size, order_by).agg(F.count("*").alias("all"), *[F.count(q(n)).alias(f"c{i}") for i, n in enumerate(left)]).first()
        enough = [n for i, n in enumerate(left) if found[f"c{i}"] >= rows or (found["all"] < size)]
        reach |= dict.fromkeys(enough, size)
        left = [n for n in left if n not in reach]
        size *= GROWTH
    out = None
    if reach:
        top = head(df, max(reach.values()), order_by)
        place = F.struct(*[q(c) for c in order_by]) if order_by else F.struct(F.monotonically_increasing_id().alias("at"))
        seen = lambda n: q(n).isNotNull() & (q(ROW_INDEX) < reach[n]) if numbered else q(n).isNotNull()
        parts = F.array(*[F.when(seen(n), F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("value"))) for n in reach])
        values = top.select(F.explode(F.array_compact(parts)).alias("x"), place.alias("place")).select("x.column", "x.value", "place")
        order = Window.partitionBy("column").orderBy("place")
        out = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).select("column", "value")
    for n in alone:
        part = head(df.where(q(n).isNotNull()), rows, order_by).select(F.lit(n).alias("column"), q(n).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
