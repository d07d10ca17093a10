"""Files as datasets: CSV, Parquet, JSON arrays and JSON lines below a folder, listed and read by Spark's file systems."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import q
from ..operators.refine import RUNGS, guarded

#: What is read.
EXTENSIONS = (".csv", ".parquet", ".json", ".jsonl", ".ndjson")
SAMPLE_BYTES = 4096


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str | None
    df: DataFrame
    error: str | None = None


def error_frame(spark: SparkSession, error: str, path: str | None = None) -> DataFrame:
    return spark.createDataFrame([(error, path)], "_error string, _path string") if path is not None else spark.createDataFrame([(error,)], "_error string")


def limited(df: DataFrame, rows: int | None) -> DataFrame:
    return df.limit(rows) if rows and rows > 0 else df


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, root: str, recursive: bool = True, extensions=EXTENSIONS) -> list[tuple[str, str]]:
    """(name relative to the root, path) of files, and of Parquet folders as one, sorted by name."""
    fs, top = file_system(spark, root)
    base = fs.getFileStatus(top).getPath().toString().rstrip("/")
    out, todo = [], [top]
    while todo:
        for status in fs.listStatus(todo.pop()):
            path = status.getPath()
            name = path.toString()[len(base) + 1 :]
            if path.getName().lower().endswith(tuple(extensions)) and (status.isFile() or path.getName().lower().endswith(".parquet")):
                out.append((name, path.toString()))
            elif status.isDirectory() and recursive and not path.getName().startswith(("_", ".")):
                todo.append(path)
    return sorted(out)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; only a local master may do without that setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="sparkgauge-")
    fs, path = file_system(spark, f"{top.rstrip('/')}/scratch-{uuid.uuid4().hex}")
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the scratch folder, for what is read several times and dear to make."""
    out = f"{scratch(df.sparkSession)}/t"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


#: Rows of a task, at about, where rows are dear.
SPREAD_ROWS = 1 << 17


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """``df`` dealt over tasks of about ``rows`` rows if one of its partitions holds more, as a small file of very many rows does."""
    most, total = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return df.repartition(-(-total // rows)) if total and most > rows else df


#: The column that holds a line whose fields aren't as many as the header's.
_LINE = "_line"
_BOOLEAN = ("true", "false")
_RUNGS = (("int", RUNGS[0][1], "int"), *RUNGS)


def _texts(spark: SparkSession, path: str, names: list[str], header: bool, lines: bool = False) -> DataFrame:
    """A CSV file's fields as text, "" as null, and on demand the lines whose fields don't fit the names."""
    fields = [T.StructField(n, T.StringType()) for n in (*names, *([_LINE] if lines else []))]
    options = {"header": header, "nullValue": "", "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE}
    return spark.read.schema(T.StructType(fields)).options(**options).csv(path)


def _survey(texts: DataFrame, names: list[str], *more: Column) -> tuple[dict[str, str], dict[str, int], tuple]:
    """Types that take all values of each column, numbers of its values, and further aggregates, in one pass."""
    parts = []
    for i, n in enumerate(names):
        v = q(n)
        parts += [F.count(v).alias(f"n{i}"), F.count_if(F.lower(v).isin(*_BOOLEAN)).alias(f"b{i}"), *[F.count(guarded(v, guard, kind)).alias(f"r{i}_{k}") for k, (_, guard, kind) in enumerate(_RUNGS)]]
    row = texts.agg(*parts, *[m.alias(f"m{i}") for i, m in enumerate(more)]).first()
    types = {}
    for i, n in enumerate(names):
        fits = [name for k, (name, _, _) in enumerate(_RUNGS) if row[f"r{i}_{k}"] == row[f"n{i}"]] + ["boolean"] * (row[f"b{i}"] == row[f"n{i}"])
        types[n] = fits[0] if fits and row[f"n{i}"] else "string"
    return types, {n: row[f"n{i}"] for i, n in enumerate(names)}, tuple(row[f"m{i}"] for i in range(len(more)))


def _typed(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    guards = {name: guard for name, guard, _ in _RUNGS}

    def cast(n: str) -> Column:
        kind = types[n]
        return q(n) if kind == "string" else (F.lower(q(n)) == "true" if kind == "boolean" else guarded(q(n), guards[kind], kind)).alias(n)

    return texts.select(*[cast(n) for n in texts.columns])


def read_csv(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """With a header, types inferred from all values, "" as null.

    A file in which a line has more or fewer fields than the header is read without one: all its lines are rows, of columns column_0,
    column_1 and so on, as many as the longest line has fields; shorter lines end in nulls. ``rejects`` lists the lines that
    don't fit. One pass surveys lines and types, a second one, by such files alone, the types without a header.
    """
    names = spark.read.options(header=True, nullValue="", emptyValue="").csv(path).columns
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    texts = limited(_texts(spark, path, names, True, True), rows)
    commas = F.length(_LINE) - F.length(F.replace(_LINE, F.lit(","), F.lit("")))
    types, _, (bad, most) = _survey(texts, names, F.count(_LINE), F.max(commas))
    if not bad:
        return _typed(limited(_texts(spark, path, names, True), rows), types)
    wide = [f"column_{i}" for i in range(max(len(names), most + 1))]  # commas in quotes part no fields
    types, held, _ = _survey(limited(_texts(spark, path, wide, False), rows), wide)
    width = max([len(names), *[i + 1 for i, n in enumerate(wide) if held[n]]])
    return _typed(limited(_texts(spark, path, wide[:width], False), rows), types)


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(line, fields): the lines of a CSV file whose fields aren't as many as the header's, with the fields that it has names for."""
    names = spark.read.options(header=True, nullValue="", emptyValue="").csv(path).columns
    texts = _texts(spark, path, names, True, True).select(q(_LINE).alias("line"), F.array(*[q(n) for n in names]).alias("fields"))
    # Tests that the reader doesn't take over, as it would before it knows the line, one with all fields, as it gives no line without them.
    return texts.where((F.coalesce("line", F.lit("")) != "") & F.coalesce("line", F.array_max("fields")).isNotNull())


def read_parquet(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    return limited(spark.read.parquet(path), rows)


def read_json(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """An array of objects if the first character is a bracket, else an object per line."""
    head = spark.read.format("text").load(path).where(F.trim("value") != "").limit(1).collect()
    is_array = bool(head) and head[0][0].lstrip("﻿ \t").startswith("[")
    return limited(spark.read.option("multiLine", is_array).json(path), rows)


def read_file(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix == ".csv":
        return read_csv(spark, path, rows)
    if suffix == ".parquet":
        return read_parquet(spark, path, rows)
    if suffix in (".json", ".jsonl", ".ndjson"):
        return read_json(spark, path, rows)
    raise ValueError(f"Unsupported file type: {path}")


class LocalFiles:
    """Every file below a folder as a dataset; one that can't be read gives a one-row dataset with the error."""

    def __init__(self, spark: SparkSession, root: str, max_rows: int | None = None):
        self.spark, self.root, self.max_rows = spark, root, max_rows

    def datasets(self) -> Iterator[Dataset]:
        for name, path in listed(self.spark, self.root):
            try:
                df = read_file(self.spark, path, self.max_rows)
                df.limit(1).collect()  # readers are lazy
                yield Dataset(name, path, df)
            except Exception as e:  # noqa: BLE001 the scan goes on whatever one file holds
                yield Dataset(f"{name} (read_error)", path, error_frame(self.spark, str(e), path), str(e))


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV files of a folder, not below it."""
    return [name for name, _ in listed(spark, folder, recursive=False, extensions=(".csv",))]
