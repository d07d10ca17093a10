"""Semantic types of string columns from samples of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.firsts import first_values
from ..functions.patterns import HINTS, SEMANTIC_TYPES, matches
from ..functions.types import columns_of, numeric_columns

#: Size of a sample, share that must match, boosts by share.
SAMPLE = 200
SHARE = 0.5
BOOSTS = ((0.6, 0.03), (0.3, 0.015))


def _shares(df: DataFrame, names: Sequence[str], kinds: Sequence[str], order_by: Sequence[str] | None, blanks: bool) -> DataFrame:
    """(column, one share per kind) over the first ``SAMPLE`` values of all columns, by ``order_by`` or in the order of the scan."""
    out = first_values(df, names, SAMPLE, order_by)
    if not blanks:
        out = out.where(F.trim("value") != "")
    return out.groupBy("column").agg(*[(F.count_if(matches(F.col("value"), k)) / F.count("*")).alias(k) for k in kinds])


def semantic_types(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, semantic_type): the first type, in order of priority, that more than half of the sample matches. Blank
    values count in the sample; columns without a type are left out."""
    shares = _shares(df, columns_of(df, (T.StringType,)), list(SEMANTIC_TYPES), order_by, True)
    first = F.coalesce(*[F.when(F.col(f"`{k}`") > SHARE, F.lit(k)) for k in SEMANTIC_TYPES])
    return shares.select("column", first.alias("semantic_type")).where("semantic_type IS NOT NULL")


def value_hints(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, hint, share, boost): how many sampled values match each pattern; numeric columns have the hint numeric."""
    shares = _shares(df, columns_of(df, (T.StringType,)), list(HINTS), order_by, False)
    boost = F.lit(0.0)
    for least, value in reversed(BOOSTS):
        boost = F.when(F.col("share") >= least, F.lit(value)).otherwise(boost)
    rows = shares.select("column", F.explode(F.array(*[F.struct(F.lit(k).alias("hint"), F.col(f"`{k}`").alias("share")) for k in HINTS])).alias("x")).select("column", "x.*")
    numbers = df.sparkSession.createDataFrame([(n, "numeric", 1.0) for n in numeric_columns(df)], "column string, hint string, share double")
    return rows.withColumn("boost", boost).unionByName(numbers.withColumn("boost", F.lit(0.0)))
