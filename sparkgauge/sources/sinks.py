"""Sinks: tables in several formats, samples, reports and their index."""

from __future__ import annotations

import fcntl
import json
import math
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.refine import cast_columns, null_words

#: Rows of samples and tries of an upload.
ANOMALY_ROWS, EXPORT_ROWS, TRIES = 200, 20, 2


def _retried(write: Callable[[], None]) -> None:
    for left in reversed(range(TRIES)):
        try:
            return write()
        except Exception:  # noqa: BLE001 one more try, then the error
            if not left:
                raise


def write_csv(df: DataFrame, path: str) -> None:
    _retried(lambda: df.write.mode("overwrite").option("header", True).csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """An object a line."""
    _retried(lambda: df.write.mode("overwrite").json(path))


def _array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's objects as the lines of one array."""
    mark = "["
    for batch in batches:
        if batch.num_rows:
            marks = pa.array([mark] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column(0), "")], ["value"])
            mark = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"])], ["value"])


#: About the bytes of an array's file, as a reader takes a file whole in one task.
ARRAY_BYTES = 16 << 20


def write_json_array(df: DataFrame, path: str, file_bytes: int | None = ARRAY_BYTES) -> None:
    """Arrays of records: every file of the folder, one a partition, is a valid array. Nulls are written, as records have all fields.

    Tasks write their files by themselves. Where a partition's text is larger than ``file_bytes``, rows are dealt over as many
    files as hold about that much each; who wants one file whatever its size gives None, and coalesces the table first.
    """

    def records(df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    else:
        if file_bytes is not None:
            sizes = records(df).groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("value") + 1).alias("n"))
            most, total = sizes.agg(F.max("n"), F.sum("n")).first()
            if most > file_bytes:
                df = df.repartition(-(-total // file_bytes))
        lines = records(df).mapInArrow(_array, "value string")
    _retried(lambda: lines.write.mode("overwrite").text(path))


#: Fixed value: where a manifest lies below a table.
MANIFEST = "_symlink_format_manifest"


def write_manifest(spark: SparkSession, path: str) -> None:
    """The table's live files, a path a line, for engines that read a table by its links."""
    files = spark.read.parquet(path).inputFiles()  # names alone
    spark.createDataFrame([(f,) for f in sorted(files)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{MANIFEST}")


def write_delta(df: DataFrame, path: str, schema: dict[str, str] | None = None) -> None:
    """Null words cleaned, columns cast, and a manifest of the live files. As Delta where its format is installed, else as Parquet."""
    df = cast_columns(null_words(df), schema or {})
    try:
        df.write.format("delta").mode("overwrite").save(path)
    except Exception as e:  # noqa: BLE001 it comes as an error of Java, with its condition in the text
        if "[DATA_SOURCE_NOT_FOUND]" not in str(e):
            raise
        write_parquet(df, path)
    write_manifest(df.sparkSession, path)


WRITERS = {"csv": write_csv, "parquet": write_parquet, "json": write_json, "json_array": write_json_array, "delta": write_delta}


def write(df: DataFrame, path: str, kind: str) -> None:
    if kind not in WRITERS:
        raise ValueError(f"Unsupported format: {kind}")
    WRITERS[kind](df, path)


#: Fixed value: the part of a sample's file name where it isn't the method's name.
FILE_PARTS = {"isolation_forest": "isoforest"}


def save_sample(df: DataFrame, folder: str, name: str, method: str, order_by: list[str]) -> str:
    """The first flagged rows as one small CSV; its path."""
    safe = name.replace("/", "__")
    path = os.path.join(folder, safe, f"{safe}__{FILE_PARTS.get(method, method)}.csv")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    rows = df.orderBy(*order_by).limit(ANOMALY_ROWS)
    rows.drop("row_idx").toPandas().to_csv(path, index=False)
    return path


def export_samples(spark: SparkSession, tables: list[str], folder: str, rows: int = EXPORT_ROWS) -> list[str]:
    paths = []
    for t in tables:
        paths.append(f"{folder.rstrip('/')}/{t}.csv")
        write_csv(spark.table(t).limit(rows), paths[-1])
    return paths


def write_json_report(report: dict, path: str, indent: int = 2) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=indent, ensure_ascii=False, default=str)


def write_schema_report(schema: dict[str, str], path: str) -> None:
    write_json_report(schema, path, indent=4)


def write_text(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


class ReportStore:
    """Reports and an index of runs in a folder of the driver; statuses are queued, complete and error."""

    STATUSES = ("queued", "complete", "error")

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)
        self._index = os.path.join(folder, "index.json")

    def index(self) -> dict[str, dict]:
        if not os.path.exists(self._index):
            return {}
        with open(self._index, encoding="utf-8") as f:
            return json.load(f)

    def put(self, run: str | None = None, status: str = "queued", report: dict | None = None, error: str | None = None) -> str:
        if status not in self.STATUSES:
            raise ValueError(f"Unknown status: {status}")
        run = run or str(uuid.uuid4())
        if report is not None:
            write_json_report(report, os.path.join(self.folder, f"{run}.json"))
        with open(self._index + ".lock", "w") as lock:  # one writer at a time; readers see the old index or the new one
            fcntl.flock(lock, fcntl.LOCK_EX)
            index = self.index()
            index[run] = {"status": status, "error": error}
            write_json_report(index, self._index + ".new")
            os.replace(self._index + ".new", self._index)
        return run

    def report(self, run: str) -> dict | None:
        path = os.path.join(self.folder, f"{run}.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def found(self, run: str) -> dict:
        """The report of a run; KeyError without one."""
        report = self.report(run)
        if report is None:
            raise KeyError(f"No report of run {run}")
        return report

    def artifacts(self, run: str) -> list[dict]:
        """Saved samples of a report, with their sizes."""
        report = self.report(run) or {"datasets": []}
        paths = [p for d in report["datasets"] for p in (d.get("anomaly_samples_saved") or {}).values() if p]
        return [{"name": os.path.basename(p), "path": p, "size": os.path.getsize(p) if os.path.exists(p) else 0} for p in paths]

    def artifact(self, run: str, name: str) -> str | None:
        """The path of a saved sample: by its path, else the first of that name."""
        found = self.artifacts(run)
        return next((a["path"] for a in found if a["path"] == name), next((a["path"] for a in found if a["name"] == os.path.basename(name)), None))


    def found_artifact(self, run: str, name: str) -> str:
        """The path of a saved sample that is there; KeyError without one."""
        self.found(run)
        path = self.artifact(run, name)
        if path is None or not os.path.exists(path):
            raise KeyError(f"No artifact {name} of run {run}")
        return path


def latex_tables(results: DataFrame) -> str:
    """A table of the metrics by table and scenario, and one of their means by scenario."""
    from ..operators.evaluate import METRICS, scenario_averages

    def tabular(rows: list, names: list[str]) -> str:
        cells = lambda r: " & ".join([*[str(r[n]).replace("_", r"\_") for n in names], *[f"{100 * r[m]:.2f}\\%" if r[m] is not None else "--" for m in METRICS]])
        head = " & ".join([*names, *METRICS]).replace("_", r"\_")
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(names)}{'r' * len(METRICS)}}}", r"\hline", head + r" \\", r"\hline", *[cells(r) + r" \\" for r in rows], r"\hline", r"\end{tabular}"])

    per_table = results.orderBy("scenario", "table").collect()  # a row per table and scenario
    means = scenario_averages(results).orderBy("scenario").collect()
    return tabular(per_table, ["table", "scenario"]) + "\n\n" + tabular(means, ["scenario"]) + "\n"


def totals(report: dict) -> dict:
    """Sums over a report's datasets."""
    data = report["datasets"]
    return {"rows": sum(d["rows"] for d in data), "cols": sum(d["cols"] for d in data), "anomalies": sum(sum(d["anomalies"].values()) for d in data)}


def mapped_percent(dataset: dict) -> int:
    """Whole per cent of a report's dataset's columns that are mapped; 0 without columns."""
    return math.floor(100 * len(dataset["mapping"]) / dataset["cols"] + 0.5) if dataset["cols"] else 0


def completeness(dataset: dict) -> dict[str, int]:
    """Whole per cent of values that are there, by column."""
    return {c: math.floor(100 * (1 - r) + 0.5) for c, r in dataset["statistics"]["missing_ratios"].items()}


def summary(report: dict) -> str:
    """A few lines for each dataset."""
    lines = []
    for d in report["datasets"]:
        lines.append(f"{d['name']}: {d['rows']} rows x {d['cols']} columns")
        lines.append(f"  mapped {len(d['mapping'])} ({mapped_percent(d)} %), ambiguous {len(d['ambiguous'])}, unmapped {len(d['unmapped'])}")
        lines.append("  anomalies " + (", ".join(f"{k} {v}" for k, v in d["anomalies"].items()) or "none"))
    return "\n".join(lines)


def totals_frame(results: DataFrame) -> DataFrame:
    """Sums over (table, rows, cols)."""
    return results.agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum("cols").alias("cols"))
