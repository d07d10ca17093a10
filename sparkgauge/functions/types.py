"""Groups of Spark types and the meaning of a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
CATEGORICAL = (*INTEGERS, T.StringType)
NESTED = (T.ArrayType, T.StructType, T.MapType)
#: The row index that ``with_row_index`` adds; detectors leave it out.
ROW_INDEX = "row_idx"


def q(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame, kinds: tuple, exclude: Sequence[str] = (ROW_INDEX,)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (ROW_INDEX,), decimals: bool = False) -> list[str]:
    """Integers and floats; decimals only if asked for."""
    return columns_of(df, (*NUMERIC, T.DecimalType) if decimals else NUMERIC, exclude)


def ensure_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if len(missing) == 1:
        raise KeyError(f"Column '{missing[0]}' does not exist in the DataFrame.")
    if missing:
        raise KeyError(f"Columns {missing} do not exist in the DataFrame.")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or the empty string in a string column. Blanks and NaN are values."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return q(name).isNull() | (q(name) == "")
    return q(name).isNull()


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN as null."""
    value = q(name).cast("double")
    return F.when(~F.isnan(value), value) if isinstance(df.schema[name].dataType, FLOATS) else value


def _by_files(df: DataFrame, name: str) -> DataFrame | None:
    """The index by the files' names and the rows' places in them, if ``df`` is all rows of files that number their rows."""
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # no files, or none that number rows
        return None
    files = marked.groupBy(F.xxhash64("_file").alias("_f")).agg(F.min("_file").alias("path"), F.max("_file").alias("other"), F.count("*").alias("n"), (F.max("_row") + 1).alias("rows"))
    found = sorted(files.collect(), key=lambda r: r.path)  # a row for each file
    if any(r.n != r.rows or r.path != r.other for r in found):  # rows are missing, as behind a filter
        return None
    starts, at = [], 0
    for r in found:
        starts.append((r["_f"], at))
        at += r.n
    base = df.sparkSession.createDataFrame(starts, "_f long, _base long")  # 16 bytes a file
    out = marked.withColumn("_f", F.xxhash64("_file")).join(F.broadcast(base), "_f")
    return out.select(*[q(c) for c in df.columns], (F.col("_base") + F.col("_row")).alias(name))


def with_row_index(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """A dense 0-based index.

    Rows of Parquet files are numbered by file name and by place in the file, which is the same however they are read, split or
    moved on; counts come from the files' own numbers, without a scan of columns. Other rows are numbered in the order of
    partitions and of rows in them; only the counts of partitions come to the driver then, and the input must give the same
    partitions when read again, as files and tables do.
    """
    if {"_file", "_row", "_f", "_base"}.isdisjoint(df.columns) and (found := _by_files(df, name)) is not None:
        return found
    marked = df.withColumn("_mid", F.monotonically_increasing_id())
    counts = {r.p: r.n for r in marked.groupBy(F.shiftright("_mid", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    base = F.get(F.lit(starts or [0]).cast("array<bigint>"), F.shiftright("_mid", 33).cast("int"))
    return marked.withColumn(name, base + F.col("_mid").bitwiseAND(F.lit(2**33 - 1))).drop("_mid")
