"""Queries of whole runs through the command line and the store of reports, of variants and their records, and of reports as files."""

from __future__ import annotations

import contextlib
import io
import json
import os
import tempfile

from pyspark.sql import functions as F

from .operators import degrade as D
from .operators.evaluate import METRICS
from .plans import variants as V
from .plans.assistant import run_async
from .plans.benchmarks import folder_diffs
from .plans.cli import main
from .plans.config import AnomalyConfig, SourceConfig
from .queries import _hit_sql, add, read
from .sources.files import file_system, scratch
from .sources.sinks import ReportStore, latex_tables, write

_NUMBERS = ("event_id", "user_id", "value")
_Z_SQL = " + ".join(f"(SELECT count(*) FROM events, (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM events) WHERE d > 0 AND abs(({c} - m) / d) > 2.5)" for c in _NUMBERS)


@add("command_line_run", f"""
SELECT 'events.parquet' AS name, count(*)::BIGINT AS rows, 6::BIGINT AS cols, ({_Z_SQL})::BIGINT AS zscore, 'events.parquet: ' || count(*) || ' rows x 6 columns' AS line FROM events
""")
def command_line_run(spark, sf_dir):
    """A run by the command line, whose report is a JSON file, and the first line of its summary."""
    top = scratch(spark)
    write(read(spark, sf_dir, "events"), f"{top}/events.parquet", "parquet")
    with tempfile.TemporaryDirectory() as folder:  # reports are files of the driver
        path = os.path.join(folder, "report.json")
        with contextlib.redirect_stdout(io.StringIO()) as printed:
            failed = main(["--data-root", top, "--zscore", "--z-threshold", "2.5", "--output", path])
        if failed:
            raise RuntimeError("the run failed")
        with open(path, encoding="utf-8") as f:
            report = json.load(f)
    rows = [(d["name"], d["rows"], d["cols"], d["anomalies"]["zscore"], printed.getvalue().split("\n")[0]) for d in report["datasets"]]
    return spark.createDataFrame(rows, "name string, rows long, cols long, zscore long, line string")


@add("stored_run", """
WITH x AS (SELECT count(*) FILTER (WHERE c_custkey % 9 = 0) AS n, count(*) AS rows FROM customer)
SELECT 'complete' AS status, rows::BIGINT AS rows, n::BIGINT AS missing, 'customer.parquet__missing_values.csv' AS artifact, least(200, n)::BIGINT AS lines, n::BIGINT AS listed FROM x
""")
def stored_run(spark, sf_dir):
    """A run that goes on by itself, its place in the store, its saved sample and its table of all flagged rows."""
    top = scratch(spark)
    df = read(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 9 > 0, F.col("c_mktsegment")))
    write(df, f"{top}/customer.parquet", "parquet")
    config = AnomalyConfig(use_zscore=False, use_iqr=False, use_isolation_forest=False, use_categorical=False)
    with tempfile.TemporaryDirectory() as folder:  # reports and samples are files of the driver
        store = ReportStore(os.path.join(folder, "store"))
        run_id, thread = run_async(spark, SourceConfig("local", top), store, anomalies=config, save_dir=os.path.join(folder, "samples"))
        thread.join()
        (d,) = store.found(run_id)["datasets"]
        (artifact,) = store.artifacts(run_id)
        with open(store.found_artifact(run_id, artifact["name"]), encoding="utf-8") as f:
            lines = sum(1 for _ in f) - 1
        listed = spark.read.parquet(d["anomaly_rows_saved"]).count()
        rows = [(store.index()[run_id]["status"], d["rows"], d["anomalies"]["missing_values"], artifact["name"], lines, listed)]
    return spark.createDataFrame(rows, "status string, rows long, missing long, artifact string, lines long, listed long")


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_REST = ", ".join(f"CASE WHEN NOT gone THEN {c} END AS {c}" for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


@add("variant_table", f"""
WITH a AS (SELECT c_custkey, {_REST} FROM (SELECT * EXCLUDE (hit), hit AS gone FROM ({_hit_sql('customer', 'high_quality|missing', 0.03, 'c_custkey')})))
SELECT c_custkey, c_name, CASE WHEN hit THEN c_nationkey * 5 ELSE c_nationkey END AS c_nationkey, CASE WHEN hit THEN c_acctbal * 5 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM ({_hit_sql('a', 'high_quality|outliers', 0.01, 'c_custkey')})
""")
def variant_table(spark, sf_dir):
    """A variant as it was written, under its table's and its scenario's name."""
    top = scratch(spark)
    V.variants(read(spark, sf_dir, "customer"), "customer", ["c_custkey"], top, scenarios={"high_quality": D.SCENARIOS["high_quality"]})
    return spark.read.parquet(f"{top}/customer_high_quality")


@add("variant_record", "SELECT 'customer' AS original_table, 'low_quality' AS quality_level, count(*)::BIGINT AS rows, c.name AS \"column\", c.kind AS type, c.word AS word, (count(*) * 0.2)::INT AS missing FROM customer, (VALUES "
     + ", ".join(f"('{n}', '{k}', '{V.generator_schema({n: k})[n]}')" for n, k in _CUSTOMER.items()) + ") c(name, kind, word) GROUP BY ALL")
def variant_record(spark, sf_dir):
    """The truth record beside a variant: the clean table's types, as the generator's words too, and what was changed."""
    top = scratch(spark)
    V.variants(read(spark, sf_dir, "customer"), "customer", ["c_custkey"], top, scenarios={"low_quality": D.SCENARIOS["low_quality"]}, truth_only=True)
    record = json.loads(spark.read.text(f"{top}/customer_low_quality_truth.json", wholetext=True).first()[0])
    words = V.generator_schema(record["original_schema"])
    rows = [(record["original_table"], record["quality_level"], record["row_count"], n, k, words[n], record["degradation_metadata"]["missing"]["rows"]) for n, k in record["original_schema"].items()]
    return spark.createDataFrame(rows, "original_table string, quality_level string, rows long, column string, type string, word string, missing int")


@add("folder_schema_diffs", """
SELECT 'b.csv' AS file, v.* FROM (VALUES ('added', 'o_totalprice', 'double'), ('changed', 'o_orderkey', 'int -> string'), ('removed', 'o_custkey', 'int'), ('removed', 'o_order_status', 'string')) v(change, "column", what)
WHERE (SELECT count(*) FROM orders) > 0
""")
def folder_schema_diffs(spark, sf_dir):
    """Schemas of a folder's CSV files, with cleaned names, against the first one's; read from the reports that were written."""
    top, orders = scratch(spark), read(spark, sf_dir, "orders")
    parts = {"a.csv": orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("o_orderStatus")), "b.csv": orders.select(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_totalprice")}
    fs, _ = file_system(spark, top)
    for name, df in parts.items():
        folder = f"{scratch(spark)}/x"
        df.coalesce(1).write.option("header", True).csv(folder)  # one file is what is listed
        (file,) = spark.read.text(folder).inputFiles()
        fs.rename(file_system(spark, file)[1], file_system(spark, f"{top}/{name}")[1])
    with tempfile.TemporaryDirectory() as out:  # reports are files of the driver
        changes = folder_diffs(spark, top, out)
        rows = []
        for file, found in changes.items():
            with open(os.path.join(out, f"{file}.diff.txt"), encoding="utf-8") as f:
                text = f.read()
            for change, entries in found.items():
                for column, what in entries.items():
                    shown = f"{what['old']} -> {what['new']}" if isinstance(what, dict) else what
                    rows += [(file, change, column, shown)] * (f"  {column}: {shown}\n" in text)
    return spark.createDataFrame(rows, "file string, change string, column string, what string")


_SCORES_SQL = "SELECT source AS \"table\", lang AS scenario, avg(quality) AS anomaly_f1, avg(toxic) AS schema_accuracy, CASE WHEN source <> 'web' THEN avg(quality) END AS semantic_f1, avg(1 - toxic) AS mapping_accuracy FROM documents JOIN labels USING (doc_id) GROUP BY source, lang"
_CELL = "coalesce(printf('%.2f', 100 * {0}) || '\\%', '--')"


def _lines_sql(names: str, source: str) -> str:
    return f"SELECT {names} || ' & ' || concat_ws(' & ', {', '.join(_CELL.format(m) for m in METRICS)}) || ' \\\\' AS line FROM ({source})"


@add("latex_scores", _lines_sql("replace(\"table\", '_', '\\_') || ' & ' || replace(scenario, '_', '\\_')", _SCORES_SQL) + " UNION ALL " + _lines_sql("replace(scenario, '_', '\\_')", f"SELECT scenario, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM ({_SCORES_SQL}) GROUP BY scenario"))
def latex_scores(spark, sf_dir):
    """Shares of labels by source and language, as tables of scores in LaTeX: their lines of numbers."""
    both = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("table"), F.col("lang").alias("scenario")).join(read(spark, sf_dir, "labels"), "doc_id")
    results = both.groupBy("table", "scenario").agg(F.avg("quality").alias("anomaly_f1"), F.avg("toxic").alias("schema_accuracy"), F.avg("quality").alias("semantic_f1"), F.avg(1 - F.col("toxic")).alias("mapping_accuracy"))
    text = latex_tables(results.withColumn("semantic_f1", F.when(F.col("table") != "web", F.col("semantic_f1"))))
    return spark.createDataFrame([(line,) for line in text.split("\n") if "%" in line], "line string")
