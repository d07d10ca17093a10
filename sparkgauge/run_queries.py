"""Queries on sinks, stores, listings, made columns and whole runs, with their SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from .functions.patterns import matches
from .functions.types import ensure_columns, with_row_index
from .mapping_sql import decisions_sql
from .operators import anomalies as A
from .operators import mapping as M
from .operators import refine as R
from .operators import schemas as S
from .operators.semantic import semantic_types
from .plans import benchmarks as B
from .plans.assistant import analyze, run_stream
from .plans.config import AnomalyConfig, MappingConfig, SourceConfig
from .queries import _MISSING_SQL, _NULLS, _ORDERS, _PATTERNS, ZSCORE_EVENTS, _degraded, _iqr_sql, _rare_sql, add, columns_of_tables, read, sources_sql, written_sql
from .sources import catalog as C
from .sources.files import LocalFiles, csv_files, file_system, read_csv, read_file, rejects, scratch
from .sources.sinks import ReportStore, completeness, export_samples, mapped_percent, save_sample, write, write_delta

# columns made from a key, one of each semantic type, as text

#: Column: its text in Spark, the same in DuckDB, its type, its semantic type. ``k`` is the key.
_MADE = {
    "number": ("string(k)", "k::VARCHAR", "bigint", "Price"),
    "share": ("format_string('%d.%02d', k, k % 100)", "printf('%d.%02d', k, k % 100)", "double", "Price"),
    "flag": ("if(k % 2 = 0, 'yes', 'no')", "CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END", "boolean", None),
    "word": ("concat('word ', k)", "'word ' || k", "string", None),
    "day": ("date_format(date_add(DATE'2024-01-01', cast(k % 300 AS int)), 'yyyy-MM-dd')", "strftime(DATE '2024-01-01' + (k % 300)::INT, '%Y-%m-%d')", "date", "Date"),
    "moment": ("concat('2024-05-06 07:', lpad(k % 60, 2, '0'), ':09')", "'2024-05-06 07:' || lpad((k % 60)::VARCHAR, 2, '0') || ':09'", "timestamp_ntz", "DateTime"),
    "mail": ("concat('user', k, '@example.org')", "'user' || k || '@example.org'", "string", "Email"),
    "link": ("concat('https://example.org/', k)", "'https://example.org/' || k", "string", "URL"),
    "uuid": (
        "concat(substr(md5(string(k)), 1, 8), '-', substr(md5(string(k)), 9, 4), '-4', substr(md5(string(k)), 13, 3), '-a', substr(md5(string(k)), 16, 3), '-', substr(md5(string(k)), 19, 12))",
        "substr(md5(k::VARCHAR), 1, 8) || '-' || substr(md5(k::VARCHAR), 9, 4) || '-4' || substr(md5(k::VARCHAR), 13, 3) || '-a' || substr(md5(k::VARCHAR), 16, 3) || '-' || substr(md5(k::VARCHAR), 19, 12)",
        "string", "UUID",
    ),
    "price": ("concat('$', k, '.', 10 + k % 90)", "'$' || k || '.' || (10 + k % 90)", "string", "Price"),
    "phone": ("concat('+49 30 ', lpad(k % 1000, 3, '5'), ' 4567')", "'+49 30 ' || lpad((k % 1000)::VARCHAR, 3, '5') || ' 4567'", "string", "Phone"),
    "address": ("concat('10.0.', k % 256, '.', k % 200)", "'10.0.' || (k % 256) || '.' || (k % 200)", "string", "IP Address"),
    "card": ("concat('4', lpad(k, 15, '0'), if(k % 3 = 0, ' ', ''))", "'4' || lpad(k::VARCHAR, 15, '0') || CASE WHEN k % 3 = 0 THEN ' ' ELSE '' END", "string", "Price"),
    "mixed": ("if(k % 2 = 0, concat('u', k, '@example.org'), if(k % 3 = 0, '', '-'))", "CASE WHEN k % 2 = 0 THEN 'u' || k || '@example.org' WHEN k % 3 = 0 THEN '' ELSE '-' END", "string", None),
}
_MADE_SQL = "SELECT s_suppkey AS k, " + ", ".join(f"{sql} AS {n}" for n, (_, sql, _, _) in _MADE.items()) + " FROM supplier"


def _made(spark, sf_dir):
    return read(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "k").select("k", *[F.expr(text).alias(n) for n, (text, _, _, _) in _MADE.items()])


def _found_types_sql(source: str, key: str, columns) -> str:
    parts = []
    for c in columns:
        cases = " ".join(f"WHEN avg(CASE WHEN regexp_matches(trim({c}), '{p}') THEN 1.0 ELSE 0.0 END) > 0.5 THEN '{k}'" for k, p in _PATTERNS.items())
        parts.append(f"SELECT '{c}' AS \"column\", CASE {cases} END AS semantic_type FROM (SELECT {c} FROM ({source}) WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 200)")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE semantic_type IS NOT NULL"


_MADE_TYPES_SQL = _found_types_sql(_MADE_SQL, "k", _MADE)


@add("semantic_types_made", _MADE_TYPES_SQL)
def semantic_types_made(spark, sf_dir):
    return semantic_types(_made(spark, sf_dir), ["k"])


@add("semantic_types_cards", "SELECT 'card' AS \"column\", 'Credit Card' AS semantic_type FROM (" + _MADE_SQL + f") HAVING avg(CASE WHEN regexp_matches(trim(card), '{_PATTERNS['Credit Card']}') THEN 1.0 ELSE 0.0 END) > 0.5")
def semantic_types_cards(spark, sf_dir):
    """Card numbers match the pattern of prices before their own, so their own is asked for alone."""
    share = _made(spark, sf_dir).agg(F.avg(matches(F.col("card"), "Credit Card").cast("int")).alias("share"))
    return share.where("share > 0.5").select(F.lit("card").alias("column"), F.lit("Credit Card").alias("semantic_type"))


def _type_sql(c: str) -> str:
    """The type that a column of text allows, as the ladder of refinement goes."""
    v = f"nullif({c}, '')"
    rungs = (("bigint", "^[+-]?[0-9]+$", "BIGINT"), ("double", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "DOUBLE"), ("date", "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "DATE"), ("timestamp_ntz", "^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]{1,9})?)?$", "TIMESTAMP"))
    cases = " ".join(f"WHEN bool_and({v} IS NULL OR (regexp_matches({v}, '{p}') AND try_cast({v} AS {t}) IS NOT NULL)) THEN '{name}'" for name, p, t in rungs)
    words = ", ".join(f"'{w}'" for w in R.BOOLEAN_WORDS)
    return f"CASE WHEN count({v}) = 0 THEN 'string' WHEN bool_and({v} IS NULL OR lower({v}) IN ({words})) AND count(DISTINCT {v}) <= 2 THEN 'boolean' {cases} ELSE 'string' END"


def _typing_sql() -> str:
    types = " UNION ALL ".join(f"SELECT {_type_sql(c)} = '{want}' AS ok FROM made" for c, (_, _, want, _) in _MADE.items())
    truth = ", ".join(f"('{c}', '{k}')" for c, (_, _, _, k) in _MADE.items() if k)
    return f"""
WITH made AS ({_MADE_SQL}), t AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS a FROM ({types})),
b AS (SELECT f.semantic_type AS f, w.k AS w FROM ({_MADE_TYPES_SQL}) f FULL JOIN (VALUES {truth}) w(c, k) ON w.c = f."column"),
s AS (SELECT count(*) FILTER (WHERE f = w)::DOUBLE AS tp, count(*) FILTER (WHERE f IS NOT NULL AND f IS DISTINCT FROM w)::DOUBLE AS fp, count(*) FILTER (WHERE f IS NULL)::DOUBLE AS fn FROM b),
p AS (SELECT tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s)
SELECT a::DOUBLE AS type_accuracy, p AS "precision", r AS recall, 2 * p * r / (p + r) AS f1 FROM t, p
"""


@add("benchmark_typing", _typing_sql())
def benchmark_typing(spark, sf_dir):
    """Fourteen columns of text, from numbers to card numbers."""
    wanted = {n: kind for n, (_, _, _, kind) in _MADE.items() if kind}
    return B.typing_benchmark(_made(spark, sf_dir).drop("k"), {n: kind for n, (_, _, kind, _) in _MADE.items()}, wanted)


@add("schema_only_types", "WITH made AS (" + _MADE_SQL + ") " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {_type_sql(c)} AS type FROM made" for c in _MADE))
def schema_only_types(spark, sf_dir):
    made = _made(spark, sf_dir).drop("k")
    return S.schema_frame(R.refined(made))


# benchmarks of names

_BENCH_TABLES, _BENCH_FIELDS = ("customer", "supplier"), ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey", "s_acctbal", "s_name", "s_nationkey", "s_suppkey")
_WRITTEN_SQL = written_sql(_BENCH_TABLES)


@add("benchmark_mapping", decisions_sql(sources_sql(_WRITTEN_SQL), _BENCH_FIELDS, M.merged_synonyms(B.FIELD_SYNONYMS), 0.7, M.EPSILON) + f"""
SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END::DOUBLE AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END::DOUBLE AS recall FROM (
    SELECT transform, count(*) FILTER (WHERE target = field)::BIGINT AS tp, count(*) FILTER (WHERE target <> field)::BIGINT AS fp, count(*) FILTER (WHERE status <> 'mapped')::BIGINT AS fn,
      count(*) FILTER (WHERE status = 'ambiguous')::BIGINT AS ambiguous FROM ({_WRITTEN_SQL}) w JOIN decided ON source = w.name GROUP BY transform))
""")
def benchmark_mapping(spark, sf_dir):
    """The columns of two tables, written in seven ways, onto themselves."""
    return B.mapping_benchmark(spark, fields=columns_of_tables(spark, sf_dir, _BENCH_TABLES)).drop("ms_per_column")


#: Columns without their vowels but for the first letter.
_SHORT_SQL = f"SELECT f AS field, substr(f, 1, 3) || regexp_replace(substr(f, 4), '[aeiou]', '', 'g') AS name FROM (SELECT unnest({list(_BENCH_FIELDS)!r}) AS f)"
_SHORT_SOURCES = f"SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS place, name, false AS is_number, NULL::VARCHAR AS detected FROM ({_SHORT_SQL})"


@add("benchmark_abbreviations", decisions_sql(_SHORT_SOURCES, _BENCH_FIELDS, M.SYNONYMS, 0.6, 0.3) + f"""
SELECT source, t.field AS truth, status, target, CASE WHEN status = 'ambiguous' THEN CASE WHEN list_contains(candidates, t.field) THEN t.field END ELSE target END AS assisted
FROM decided JOIN ({_SHORT_SQL}) t ON t.name = source
""")
def benchmark_abbreviations(spark, sf_dir):
    """Columns without vowels. Ties are broken by a provider that knows the truth, so ``assisted`` is the best that any can do."""
    fields = columns_of_tables(spark, sf_dir, _BENCH_TABLES)
    truth = {f[:3] + re.sub("[aeiou]", "", f[3:]): f for f in fields}
    return B.abbreviation_benchmark(spark, lambda prompt: next((t for s, t in truth.items() if f"field {s!r}?" in prompt), None), 0.6, 0.3, truth, fields)


# sinks


@add("sink_formats", " UNION ALL ".join(f"SELECT '{k}' AS kind, c_custkey, c_name, c_acctbal FROM customer" for k in ("csv", "json", "parquet", "delta")))
def sink_formats(spark, sf_dir):
    """A table through every writer and back."""
    df, out = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), None
    for kind in ("csv", "json", "parquet", "delta"):
        path = f"{scratch(spark)}/customer.{'parquet' if kind == 'delta' else kind}"
        write(df, path, kind)
        back = read_file(spark, path).select(F.lit(kind).alias("kind"), *[F.col(c).cast(df.schema[c].dataType) for c in df.columns])
        out = back if out is None else out.unionByName(back)
    return out


@add("sink_delta_casts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS o_totalprice FROM orders
""")
def sink_delta_casts(spark, sf_dir):
    """Null words become null and columns are cast before they are written."""
    text = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "if(o_orderkey % 4 = 0, 'NaN', o_orderpriority) AS o_orderpriority", "cast(o_custkey AS string) AS o_custkey", "if(o_orderkey % 3 > 0, cast(o_totalprice AS string), 'none') AS o_totalprice")
    path = f"{scratch(spark)}/orders.parquet"
    write_delta(text, path, {"o_custkey": "int", "o_totalprice": "float"})
    return read_file(spark, path)


@add("sink_anomaly_sample", f"SELECT event_id, value FROM ({ZSCORE_EVENTS}) ORDER BY event_id LIMIT 200")
def sink_anomaly_sample(spark, sf_dir):
    flagged = with_row_index(A.zscore(read(spark, sf_dir, "events").select("event_id", "value"), "value"))
    with tempfile.TemporaryDirectory() as folder:  # samples are files of the driver
        with open(save_sample(flagged, folder, "events.parquet", "zscore", ["event_id"]), encoding="utf-8") as f:
            rows = [x.split(",") for x in f.read().splitlines()[1:]]
    return spark.createDataFrame([(int(i), float(v)) for i, v in rows], "event_id long, value double")


@add("sink_table_export", "SELECT r_regionkey, r_name FROM region")
def sink_table_export(spark, sf_dir):
    view = "export_" + uuid.uuid4().hex
    read(spark, sf_dir, "region").select("r_regionkey", "r_name").createOrReplaceTempView(view)
    (path,) = export_samples(spark, [view], scratch(spark))
    out = read_csv(spark, path)
    return out.select(F.col("r_regionkey").cast(read(spark, sf_dir, "region").schema["r_regionkey"].dataType), "r_name")


@add("report_store", "SELECT 'done' AS run, 'complete' AS status, count(*)::BIGINT AS rows, NULL::VARCHAR AS error FROM nation UNION ALL SELECT 'lost', 'error', NULL, 'no table' UNION ALL SELECT 'next', 'queued', NULL, NULL")
def report_store(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # reports are files of the driver
        store = ReportStore(folder)
        store.put("done", "complete", {"datasets": [{"rows": read(spark, sf_dir, "nation").count()}]})
        store.put("lost", "error", error="no table")
        store.put("next")
        rows = [(run, x["status"], (store.report(run) or {"datasets": [{"rows": None}]})["datasets"][0]["rows"], x["error"]) for run, x in store.index().items()]
    return spark.createDataFrame(rows, "run string, status string, rows long, error string")


# sources


def _ragged(spark, sf_dir) -> str:
    """The orders as CSV of one file a partition, some lines with a field more and some with one less."""
    top = f"{scratch(spark)}/orders.csv"
    fields = ["o_orderkey", "o_custkey", "o_orderstatus"]
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in fields])
    at = F.col("o_orderkey") % 10
    line = F.when(at == 0, F.concat(line, F.lit(',"more, quoted",'), F.col("o_orderpriority"))).when(at == 1, F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))).otherwise(line)
    read(spark, sf_dir, "orders").select(line.alias("value")).write.text(top)
    return top


@add("scan_headerless_csv", """
SELECT o_orderkey::BIGINT AS column_0, o_custkey::BIGINT AS column_1, CASE WHEN o_orderkey % 10 <> 1 THEN o_orderstatus END AS column_2, CASE WHEN o_orderkey % 10 = 0 THEN 'more, quoted' END AS column_3,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority END AS column_4 FROM orders
""")
def scan_headerless_csv(spark, sf_dir):
    """Lines that don't fit the first show that it is no header; every field of every line is kept."""
    return read_csv(spark, _ragged(spark, sf_dir))


@add("csv_rejects", """
WITH x AS (SELECT *, CASE o_orderkey % 10 WHEN 0 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus, '"more, quoted"', o_orderpriority) ELSE concat_ws(',', o_orderkey, o_custkey) END AS line FROM orders WHERE o_orderkey % 10 < 2)
SELECT line FROM x
""")
def csv_rejects(spark, sf_dir):
    """The lines with more or fewer fields than the header."""
    top = _ragged(spark, sf_dir)
    headed = f"{scratch(spark)}/headed.csv"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0  # a header for each file
    head = F.lit("key,customer,status")
    spark.read.text(top).select(F.explode(F.when(first, F.array(head, F.col("value"))).otherwise(F.array("value"))).alias("value")).write.text(headed)
    lines = rejects(spark, headed)
    return lines.select("line")


@add("csv_listing", "SELECT 'a.csv' AS name, count(*)::BIGINT AS rows FROM region UNION ALL SELECT 'b.CSV', count(*)::BIGINT FROM nation")
def csv_listing(spark, sf_dir):
    """CSV files of a folder, not of those below it, with their rows."""
    top = scratch(spark)
    for name, t in (("b.CSV", "nation"), ("a.csv", "region"), ("c.json", "region"), ("deep/d.csv", "nation")):
        part = f"{scratch(spark)}/{t}"
        read(spark, sf_dir, t).coalesce(1).write.option("header", True).csv(part)  # a few rows
        (file,) = spark.read.text(part).inputFiles()
        fs, path = file_system(spark, f"{top}/{name}")
        fs.mkdirs(path.getParent())
        fs.rename(file_system(spark, file)[1], path)
    return spark.createDataFrame([(n, read_csv(spark, f"{top}/{n}").count()) for n in csv_files(spark, top)], "name string, rows long")


@add("catalog_listing", """
SELECT 'source' AS kind, 'sales' AS name UNION ALL SELECT 'nested', 'sales_low_quality_low_quality' UNION ALL SELECT 'left', t FROM (VALUES ('sales'), ('sales_low_quality'), ('sales_truth')) v(t)
UNION ALL SELECT 'found', 'sales_truth' UNION ALL SELECT 'column', column_name FROM (DESCRIBE region) UNION ALL SELECT 'rows', count(*)::VARCHAR FROM region UNION ALL SELECT 'absent', '0'
""")
def catalog_listing(spark, sf_dir):
    """Tables, those that are no variants, a lookup by name, variants of variants, a schema and a download."""
    schema = "list_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch(spark)}'")
    for name in ("sales", "sales_low_quality", "sales_low_quality_low_quality", "sales_truth"):
        top = f"{scratch(spark)}/{name}"
        write(read(spark, sf_dir, "region"), top, "parquet")
        C.promote(spark, (schema, name), top)
    rows = [("source", n) for n in C.source_tables(spark, schema)] + [("nested", n) for n in C.drop_nested_variants(spark, schema)] + [("left", n) for n in C.tables(spark, schema)]
    rows += [("found", t) for s, t in C.find(spark, "*_truth", schema)] + [("column", c) for c in C.table_schema(spark, f"{schema}.sales")]
    df, _ = C.download(spark, f"{schema}.sales")
    gone, _ = C.download(spark, f"{schema}.absent")
    rows += [("rows", str(df.count())), ("absent", str(len(gone.columns)))]
    spark.sql(f"DROP DATABASE {schema} CASCADE")
    return spark.createDataFrame(rows, "kind string, name string")


# whole runs

_EVENT_NUMBERS = ("event_id", "user_id", "value")


@add("analyze_anomalies", "SELECT (" + " + ".join(
    f"(SELECT count(*) FILTER (WHERE d > 0 AND abs(({c} - m) / d) > 3.0) FROM events, (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM events))" for c in _EVENT_NUMBERS
) + ")::BIGINT AS zscore, (" + " + ".join(f"(SELECT count(*) FROM ({_iqr_sql('events', c, c)}))" for c in _EVENT_NUMBERS) + f""")::BIGINT AS iqr,
  (SELECT count(*) FROM ({_rare_sql('events', ('event_id', 'user_id', 'event_type'), 'event_id')}))::BIGINT AS categorical""")  # fmt: skip
def analyze_anomalies(spark, sf_dir):
    """Counts of a whole run over a folder; methods that find nothing are 0."""
    top = scratch(spark)
    write(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), f"{top}/events.parquet", "parquet")
    (d,) = analyze(LocalFiles(spark, top), AnomalyConfig(use_isolation_forest=False, use_missing=False))["datasets"]
    return spark.createDataFrame([tuple(d["anomalies"].get(k, 0) for k in ("zscore", "iqr", "categorical"))], "zscore long, iqr long, categorical long")


@add("analyze_missing", f"SELECT count(*) FILTER (WHERE n >= 1)::BIGINT AS t1, count(*) FILTER (WHERE n >= 5)::BIGINT AS t5 FROM (SELECT {_NULLS} AS n FROM ({_MISSING_SQL}))")
def analyze_missing(spark, sf_dir):
    top = scratch(spark)
    write(_degraded(spark, sf_dir), f"{top}/orders.parquet", "parquet")
    config = {"use_zscore": False, "use_iqr": False, "use_isolation_forest": False, "use_categorical": False}
    found = [analyze(LocalFiles(spark, top), AnomalyConfig(**config, missing_threshold=t))["datasets"][0]["anomalies"].get("missing_values", 0) for t in (1, 5)]
    return spark.createDataFrame([tuple(found)], "t1 long, t5 long")


@add("report_completeness", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", floor(100 * (count({c}) / count(*)) + 0.5)::INT AS percent, 17::INT AS mapped FROM ({_MISSING_SQL})" for c in _ORDERS))
def report_completeness(spark, sf_dir):
    """Whole per cent of values that are there, and of columns that are mapped: one of six."""
    top = scratch(spark)
    write(_degraded(spark, sf_dir), f"{top}/orders.parquet", "parquet")
    config = AnomalyConfig(use_zscore=False, use_iqr=False, use_isolation_forest=False, use_categorical=False, use_missing=False)
    (d,) = analyze(LocalFiles(spark, top), config, MappingConfig(("o_orderdate",), threshold=1.0))["datasets"]
    return spark.createDataFrame([(c, p, mapped_percent(d)) for c, p in completeness(d).items()], "column string, percent int, mapped int")


@add("run_events", "SELECT * FROM (VALUES (0, 'progress', 5), (1, 'progress', 10), (2, 'progress', 30), (3, 'progress', 50), (4, 'progress', 70), (5, 'progress', 75), (6, 'progress', 80), (7, 'complete', NULL)) v(place, event, percent)")
def run_events(spark, sf_dir):
    top = scratch(spark)
    write(read(spark, sf_dir, "region"), f"{top}/region.parquet", "parquet")
    events = run_stream(spark, SourceConfig("local", top), anomalies=AnomalyConfig(use_isolation_forest=False))
    return spark.createDataFrame([(i, e["event"], e.get("percent")) for i, e in enumerate(events)], "place int, event string, percent int")


@add("detector_dispatch", f"""
SELECT 'zscore' AS method, count(*)::BIGINT AS rows FROM ({ZSCORE_EVENTS}) UNION ALL SELECT 'iqr', count(*)::BIGINT FROM ({_iqr_sql('events', 'value', 'event_id')})
UNION ALL SELECT 'categorical', count(*)::BIGINT FROM ({_rare_sql('events', ('event_id', 'user_id', 'event_type', 'props'), 'event_id')}) UNION ALL SELECT 'missing_values', 0 UNION ALL SELECT 'isolation_forest', (count(*) * 0.01)::BIGINT FROM events
""")
def detector_dispatch(spark, sf_dir):
    """Every detector by its name. The forest's scores have ties at most at its bound, so its count is the share asked for."""
    df = read(spark, sf_dir, "events")
    ensure_columns(df, ["value"])
    counts = [(m, A.detect(df, m, c, t).count()) for m, c, t in (("zscore", ["value"], 3.0), ("iqr", ["value"], 3.0), ("categorical", None, 3.0), ("missing_values", None, 1), ("isolation_forest", ["user_id", "value"], 3.0))]
    return spark.createDataFrame(counts, "method string, rows long")
