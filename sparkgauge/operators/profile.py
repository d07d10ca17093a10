"""Profiles of tables: missing shares, numbers, texts, categories, nested columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.firsts import head
from ..functions.types import CATEGORICAL, NESTED, columns_of, is_missing, number, numeric_columns, q
from .anomalies import SKETCH, _low_cardinality, frequencies

#: Rows that text statistics cover, values they name, bounds of a category.
TEXT_ROWS, TOP_VALUES = 10_000, 3
CATEGORY_SHARE, CATEGORY_VALUES = 0.05, 100


def _long(df: DataFrame, row: DataFrame, names: list[str], fields: dict) -> DataFrame:
    """One aggregated row as a row per column."""
    parts = [F.struct(F.lit(n).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in fields]) for i, n in enumerate(names)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*") if parts else df.sparkSession.createDataFrame([], T.StructType([T.StructField("column", T.StringType()), *[T.StructField(k, t) for k, t in fields.items()]]))


def _missing_parts(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.avg(is_missing(df, n).cast("double")), F.lit(0.0)).alias(f"missing_ratio{i}") for i, n in enumerate(df.columns)]


def _number_parts(df: DataFrame, names: list[str]) -> list[Column]:
    parts = []
    for i, n in enumerate(names):
        x = q(n).cast("double")
        real = number(df, n)
        parts += [F.avg(x).alias(f"mean{i}"), F.coalesce(F.min(real), F.min(x)).alias(f"min{i}"), F.coalesce(F.max(real), F.max(x)).alias(f"max{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"std{i}"), F.count_if(x == 0).alias(f"zeros{i}")]
    return parts


def missing_ratios(df: DataFrame) -> DataFrame:
    """(column, missing_ratio); 0.0 on an empty table."""
    return _long(df, df.agg(*_missing_parts(df)), df.columns, {"missing_ratio": T.DoubleType()})


def numeric_stats(df: DataFrame) -> DataFrame:
    """(column, mean, min, max, std, zeros) with sample deviation, 0.0 for one value; columns of nulls are left out.

    NaN makes the mean and the deviation NaN; smallest and largest skip it, unless nothing else is there.
    """
    names = numeric_columns(df)
    parts = _number_parts(df, names)
    fields = {k: T.DoubleType() for k in ("mean", "min", "max", "std")} | {"zeros": T.LongType()}
    return _long(df, df.agg(*parts) if parts else df, names, fields).where("min IS NOT NULL")


@dataclass(frozen=True)
class Survey:
    """What one pass over a table tells."""

    rows: int
    missing: dict[str, float]
    numbers: dict[str, dict[str, float]]
    moments: dict[str, tuple[float | None, float | None]]
    distinct: dict[str, int]


def survey(df: DataFrame) -> Survey:
    """Rows, missing ratios, statistics of numbers, mean and population deviation without NaN, and sketched numbers of distinct
    values, all from one aggregate."""
    numeric, candidates = numeric_columns(df), columns_of(df, CATEGORICAL)
    parts = [F.count("*").alias("rows"), *_missing_parts(df), *_number_parts(df, numeric)]
    for i, n in enumerate(numeric):
        parts += [F.avg(number(df, n)).alias(f"avg{i}"), F.stddev_pop(number(df, n)).alias(f"dev{i}")]
    parts += [F.approx_count_distinct(q(n), SKETCH).alias(f"distinct{i}") for i, n in enumerate(candidates)]
    row = df.agg(*parts).first()
    numbers = {n: {k: row[f"{k}{i}"] for k in ("mean", "min", "max", "std", "zeros")} for i, n in enumerate(numeric) if row[f"min{i}"] is not None}
    return Survey(
        row.rows, {n: row[f"missing_ratio{i}"] for i, n in enumerate(df.columns)}, numbers, {n: (row[f"avg{i}"], row[f"dev{i}"]) for i, n in enumerate(numeric)}, {n: row[f"distinct{i}"] for i, n in enumerate(candidates)},
    )


def text_stats(df: DataFrame, order_by: list[str] | None = None, rows: int = TEXT_ROWS) -> DataFrame:
    """(column, unique_count, rank, value, count): the top values of string columns over the first rows.

    Rows are first by ``order_by``, else in the order of the scan. Null counts as a value and reads "None"; of equally
    frequent values the smaller comes first. The rows are bounded, and so is what follows.
    """
    names = columns_of(df, (T.StringType,))
    if not names:
        return df.sparkSession.createDataFrame([], "column string, unique_count long, rank int, value string, count long")
    counts = frequencies(head(df, rows, order_by).select(*[q(n) for n in names]), names)
    unique = Window.partitionBy("column")
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    counts = counts.select("column", F.count("*").over(unique).alias("unique_count"), F.row_number().over(order).alias("rank"), F.coalesce("value", F.lit("None")).alias("value"), F.col("n").alias("count"))
    return counts.where(F.col("rank") <= TOP_VALUES)


def categorical_columns(df: DataFrame, known: tuple[int, DataFrame] | None = None) -> DataFrame:
    """(column, n_unique) of strings and integers with few distinct values, null among them, for their rows. ``known`` are the
    rows and the frequencies of values where they have been counted."""
    rows, names = (known[0], True) if known else _low_cardinality(df, columns_of(df, CATEGORICAL), CATEGORY_VALUES)
    if not names or not rows:
        return df.sparkSession.createDataFrame([], "column string, n_unique long")
    counts = (known[1] if known else frequencies(df, names)).groupBy("column").agg(F.count("*").alias("n_unique"))
    return counts.where((F.col("n_unique") / F.lit(rows) < CATEGORY_SHARE) & (F.col("n_unique") < CATEGORY_VALUES))


def nested_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NESTED)


def schema_of(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def shape(df: DataFrame, name: str) -> DataFrame:
    """(table, rows, cols)."""
    return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("long").alias("cols"))


def preview(df: DataFrame, order_by: list[str], rows: int = 5) -> DataFrame:
    return df.orderBy(*order_by).limit(rows)
