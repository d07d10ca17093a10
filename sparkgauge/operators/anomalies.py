"""Detectors of anomalous rows.

Bounds and rare values are found by one aggregate over the input and then stand in the plan as literals, so the detector
itself is a filter that reaches the scan. Nothing else than such bounds comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.types import CATEGORICAL, columns_of, ensure_columns, is_missing, number, numeric_columns, q

#: Defaults of the detectors.
Z_THRESHOLD = 3.0
IQR_REACH = 1.5
RARE_SHARE = 0.01
MAX_DISTINCT, MIN_DISTINCT, DISTINCT_SHARE = 100, 2, 0.1
#: Relative error of the sketch that rules columns out; twice as many values as sought pass.
SKETCH = 0.05


def zscore_bounds(df: DataFrame, names: Sequence[str], threshold: float = Z_THRESHOLD) -> dict[str, tuple[float, float] | None]:
    """Mean less and plus ``threshold`` population deviations; None where there is no spread, or an infinite value leaves
    no finite one."""
    ensure_columns(df, names)
    if not names:
        return {}
    row = df.agg(*[f(number(df, n)).alias(f"{a}{i}") for i, n in enumerate(names) for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return bounds_of({n: (row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(names)}, threshold)


def bounds_of(moments: dict[str, tuple[float | None, float | None]], threshold: float = Z_THRESHOLD) -> dict[str, tuple[float, float] | None]:
    """The same from means and population deviations."""
    out = {}
    for n, (mean, std) in moments.items():
        out[n] = (mean - threshold * std, mean + threshold * std) if std and math.isfinite(mean) and math.isfinite(std) else None
    return out


def iqr_bounds(df: DataFrame, names: Sequence[str], reach: float = IQR_REACH) -> dict[str, tuple[float, float] | None]:
    """Quartiles less and plus ``reach`` times their distance, which may be 0; None where there are no values, or a quartile
    is infinite."""
    ensure_columns(df, names)
    found = quantiles(df, {n: number(df, n) for n in names}, (0.25, 0.75))
    return {n: (a - reach * (b - a), b + reach * (b - a)) if a is not None and math.isfinite(a) and math.isfinite(b) else None for n, (a, b) in found.items()}


def outside(df: DataFrame, name: str, bounds: tuple[float, float] | None) -> Column:
    """True for values beyond the bounds; false for null and NaN."""
    if bounds is None:
        return F.lit(False)
    value = number(df, name)
    return F.coalesce((value < F.lit(bounds[0])) | (value > F.lit(bounds[1])), F.lit(False))


def zscore(df: DataFrame, column: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    return df.where(outside(df, column, zscore_bounds(df, [column], threshold)[column]))


def iqr(df: DataFrame, column: str, reach: float = IQR_REACH) -> DataFrame:
    return df.where(outside(df, column, iqr_bounds(df, [column], reach)[column]))


def frequencies(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value as text, n) in long form: one shuffle for all columns, after partial counts."""
    parts = F.array(*[F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("value")) for n in names])
    return df.select(F.explode(parts).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def _low_cardinality(df: DataFrame, names: Sequence[str], most: int) -> tuple[int, list[str]]:
    """Row count and the columns that a sketch can't rule out to have ``most`` distinct values or fewer."""
    if not names:
        return df.count(), []
    row = df.agg(F.count("*").alias("rows"), *[F.approx_count_distinct(q(n), SKETCH).alias(f"d{i}") for i, n in enumerate(names)]).first()
    return row.rows, few_valued({n: row[f"d{i}"] for i, n in enumerate(names)}, most)


def few_valued(distinct: dict[str, int], most: int) -> list[str]:
    """The columns that sketched numbers of distinct values can't rule out."""
    return [n for n, d in distinct.items() if d <= 2 * most]


def rare_values(df: DataFrame, share: float = RARE_SHARE, known: tuple[int, DataFrame] | None = None) -> dict[str, list[str]]:
    """Values (as text) of candidate columns that fewer than ``share`` of the rows have; null isn't among them.

    Candidates are strings and integers with at most 100 distinct values and at most a tenth of the rows (2 at least),
    null counting as a value. ``known`` are the rows and the frequencies of values where they have been counted.
    """
    if known is None:
        rows, names = _low_cardinality(df, columns_of(df, CATEGORICAL), MAX_DISTINCT)
        known = rows, frequencies(df, names) if names else None
    rows, counts = known
    if not rows or counts is None:
        return {}
    distinct = {r.column: r.n for r in counts.groupBy("column").agg(F.count("*").alias("n")).collect()}
    use = [n for n in df.columns if n in distinct and distinct[n] <= min(MAX_DISTINCT, max(MIN_DISTINCT, DISTINCT_SHARE * rows))]
    out: dict[str, list[str]] = {n: [] for n in use}
    if use:
        for r in counts.where(F.col("column").isin(use) & F.col("value").isNotNull() & (F.col("n") < share * rows)).orderBy("column", "value").collect():  # 100 a column at most
            out[r.column].append(r.value)
    return out


def has_rare(df: DataFrame, values: dict[str, list[str]]) -> Column:
    tests = [F.coalesce(q(n).cast("string").isin(v), F.lit(False)) for n, v in values.items() if v]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def rare_categories(df: DataFrame, share: float = RARE_SHARE) -> DataFrame:
    return df.where(has_rare(df, rare_values(df, share)))


def missing_count(df: DataFrame, names: Sequence[str] | None = None) -> Column:
    tests = [is_missing(df, n).cast("int") for n in (df.columns if names is None else names)]
    return reduce(Column.__add__, tests) if tests else F.lit(0)


def missing_rows(df: DataFrame, threshold: int = 1, names: Sequence[str] | None = None) -> DataFrame:
    return df.where(missing_count(df, names) >= threshold)


def detect(df: DataFrame, method: str, columns: Sequence[str] | None = None, threshold: float = Z_THRESHOLD, contamination: float = 0.01, n_estimators: int = 100, random_state: int = 42) -> DataFrame:
    """One detector by name: zscore and iqr on one column, isolation_forest on all numeric columns or those given."""
    if method in ("zscore", "iqr"):
        if not columns or len(columns) != 1:
            raise ValueError(f"{method} requires exactly one column")
        return zscore(df, columns[0], threshold) if method == "zscore" else iqr(df, columns[0])
    if method == "isolation_forest":
        from .forest import isolation_forest

        return isolation_forest(df, columns or numeric_columns(df), contamination, n_estimators, random_state)
    if method == "categorical":
        return rare_categories(df)
    if method == "missing_values":
        return missing_rows(df, int(threshold))
    raise ValueError(f"Unknown method: {method}")


def flags(
    df: DataFrame, z_threshold: float | None = Z_THRESHOLD, with_iqr: bool = True, with_rare: bool = True, missing_threshold: int | None = 1, names: Sequence[str] | None = None,
    z_bounds: dict[str, tuple[float, float] | None] | None = None, rare: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``df`` with a struct ``flags``: per method, an array of the columns that flag the row, or a boolean.

    All detectors together cost the aggregates for bounds that aren't given (``z_bounds``, ``rare``) and one scan.
    """
    names = numeric_columns(df) if names is None else list(names)
    parts = []

    def which(bounds) -> Column:
        return F.array_compact(F.array(*[F.when(outside(df, n, b), F.lit(n)) for n, b in bounds.items()])) if bounds else F.array().cast("array<string>")

    if z_threshold is not None:
        parts.append(which(zscore_bounds(df, names, z_threshold) if z_bounds is None else z_bounds).alias("zscore"))
    if with_iqr:
        parts.append(which(iqr_bounds(df, names)).alias("iqr"))
    if with_rare:
        parts.append(has_rare(df, rare_values(df) if rare is None else rare).alias("categorical"))
    if missing_threshold is not None:
        parts.append((missing_count(df) >= missing_threshold).alias("missing_values"))
    return df.withColumn("flags", F.struct(*parts))


def union_of_rows(df: DataFrame, keys: Sequence[str], z_threshold: float = Z_THRESHOLD, forest: DataFrame | None = None) -> DataFrame:
    """Distinct keys of the rows that z-score or interquartile range, or a forest's result, flags in any numeric column."""
    names = numeric_columns(df, exclude=[*keys, "row_idx"])
    found = flags(df, z_threshold, True, False, None, names).where((F.size("flags.zscore") > 0) | (F.size("flags.iqr") > 0)).select(*[q(k) for k in keys])
    if forest is not None:
        found = found.unionByName(forest.select(*[q(k) for k in keys]))
    return found.distinct()
