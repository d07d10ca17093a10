"""The engine's queries over the test tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import clean, normalized, tokens
from .functions.patterns import SEMANTIC_TYPES
from .functions.types import numeric_columns, with_row_index
from .mapping_sql import clean_sql, decisions_sql, normalized_sql, tokens_sql, values_sql
from .operators import anomalies as A
from .operators import degrade as D
from .operators import evaluate as E
from .operators import mapping as M
from .operators import profile as P
from .operators import refine as R
from .operators import schemas as S
from .operators.forest import isolation_forest
from .operators.semantic import semantic_types, value_hints
from .plans import benchmarks as B
from .plans import variants as V
from .plans.assistant import analyze
from .plans.config import AnomalyConfig
from .sources.catalog import SqlSource, drop, promote, query
from .sources.files import LocalFiles, read_file, scratch
from .sources.sinks import write

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# anomalies

ZSCORE_EVENTS = """
WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
SELECT e.event_id, e.user_id, e.event_type, e.value FROM events e, s WHERE abs((e.value - s.m) / s.d) > 3.0
"""


@add("anomaly_zscore_events", ZSCORE_EVENTS)
def anomaly_zscore_events(spark, sf_dir):
    return A.zscore(read(spark, sf_dir, "events"), "value").select("event_id", "user_id", "event_type", "value")


def _iqr_sql(table: str, column: str, keys: str) -> str:
    return f"""
WITH s AS (SELECT quantile_cont({column}::DOUBLE, 0.25) AS a, quantile_cont({column}::DOUBLE, 0.75) AS b FROM {table})
SELECT {keys} FROM {table}, s WHERE {column} < a - 1.5 * (b - a) OR {column} > b + 1.5 * (b - a)
"""


@add("anomaly_iqr_events", _iqr_sql("events", "value", "event_id, value"))
def anomaly_iqr_events(spark, sf_dir):
    return A.iqr(read(spark, sf_dir, "events"), "value").select("event_id", "value")


@add("anomaly_iqr_documents", _iqr_sql("documents", "n_chars", "doc_id, n_chars"))
def anomaly_iqr_documents(spark, sf_dir):
    return A.iqr(read(spark, sf_dir, "documents"), "n_chars").select("doc_id", "n_chars")


@add("anomaly_iqr_zero_spread", _iqr_sql("labels", "quality", "doc_id, quality"))
def anomaly_iqr_zero_spread(spark, sf_dir):
    return A.iqr(read(spark, sf_dir, "labels"), "quality").select("doc_id", "quality")


_NUMBERS = (("events", "event_id"), ("events", "user_id"), ("events", "value"), ("documents", "doc_id"), ("documents", "n_chars"))


def _counts_sql() -> str:
    parts = []
    for t, c in _NUMBERS:
        parts.append(f"""
SELECT '{t}' AS "table", '{c}' AS "column", count(*) FILTER (WHERE d > 0 AND abs(({c} - m) / d) > 3.0)::BIGINT AS zscore,
  count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))::BIGINT AS iqr
FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS d, quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {t}) s""")
    return " UNION ALL ".join(parts)


@add("anomaly_counts", _counts_sql())
def anomaly_counts(spark, sf_dir):
    out = None
    for t in ("events", "documents"):
        df = read(spark, sf_dir, t)
        names = numeric_columns(df)
        flagged = A.flags(df, 3.0, True, False, None)
        row = flagged.agg(*[F.count_if(F.array_contains(f"flags.{m}", n)).alias(f"{m}_{n}") for m in ("zscore", "iqr") for n in names])
        parts = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(n).alias("column"), F.col(f"zscore_{n}").alias("zscore"), F.col(f"iqr_{n}").alias("iqr")) for n in names])
        rows = row.select(F.explode(parts).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@add("anomaly_union_rows", f"""
SELECT DISTINCT event_id FROM (SELECT event_id FROM ({ZSCORE_EVENTS}) UNION ALL SELECT event_id FROM ({_iqr_sql('events', 'value', 'event_id')})
UNION ALL SELECT event_id FROM ({_iqr_sql('events', 'user_id', 'event_id')}) UNION ALL
SELECT event_id FROM events, (SELECT avg(user_id) AS m, stddev_pop(user_id) AS d FROM events) WHERE abs((user_id - m) / d) > 3.0)
""")
def anomaly_union_rows(spark, sf_dir):
    return A.union_of_rows(read(spark, sf_dir, "events"), ["event_id"])


def _rare_sql(table: str, columns: tuple[str, ...], keys: str) -> str:
    names = ", ".join(columns)
    parts = " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::VARCHAR AS v FROM {table}" for c in columns)
    tests = " OR ".join(f"{c}::VARCHAR IN (SELECT v FROM rare WHERE c = '{c}')" for c in columns)
    return f"""
WITH n AS (SELECT count(*) AS n FROM {table}), f AS (SELECT c, v, count(*) AS k FROM ({parts}) GROUP BY c, v),
ok AS (SELECT c FROM f, n GROUP BY c, n HAVING count(*) <= least(100, greatest(2, 0.1 * n))),
rare AS (SELECT c, v FROM f, n WHERE c IN (SELECT c FROM ok) AND k < 0.01 * n)
SELECT {keys} FROM {table} WHERE {tests}
"""


@add("anomaly_rare_category", _rare_sql("events", ("event_id", "user_id", "event_type", "props"), "event_id, event_type, props"))
def anomaly_rare_category(spark, sf_dir):
    return A.rare_categories(read(spark, sf_dir, "events")).select("event_id", "event_type", "props")


@add("anomaly_rare_category_lineitem", _rare_sql("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_orderkey, l_linenumber"))
def anomaly_rare_category_lineitem(spark, sf_dir):
    return A.rare_categories(read(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber")


@add("isolation_forest_events")
def isolation_forest_events(spark, sf_dir):
    return isolation_forest(read(spark, sf_dir, "events"), ["user_id", "value"]).select("event_id", "user_id", "value", "is_anomaly")


# degradation: the rows of smallest hash, in both engines


def _hash_sql(seed: str, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'{k}::VARCHAR' for k in keys)})), 1, 13))::BIGINT"


def _hit_sql(table: str, seed: str, share: float, *keys: str, source: str | None = None) -> str:
    h = _hash_sql(seed, *keys)
    return f"SELECT *, row_number() OVER (ORDER BY {h}) <= floor(count(*) OVER () * {share}::DOUBLE) AS hit FROM {source or table}"


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_MISSING_SQL = "SELECT o_orderkey, " + ", ".join(f"CASE WHEN NOT hit THEN {c} END AS {c}" for c in _ORDERS[1:]) + f" FROM ({_hit_sql('orders', 'missing', 0.1, 'o_orderkey')})"


@add("degrade_missing", _MISSING_SQL)
def degrade_missing(spark, sf_dir):
    return D.missing(read(spark, sf_dir, "orders"), ["o_orderkey"], 0.1)[0]


@add("degrade_outliers", f"""
SELECT o_orderkey, CASE WHEN hit THEN o_custkey * 5 ELSE o_custkey END AS o_custkey, o_orderstatus,
  CASE WHEN hit THEN o_totalprice * 5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM ({_hit_sql('orders', 'outliers', 0.05, 'o_orderkey')})
""")
def degrade_outliers(spark, sf_dir):
    return D.outliers(read(spark, sf_dir, "orders"), ["o_orderkey"], 0.05)[0]


@add("degrade_invalid", f"""
SELECT c_custkey, CASE WHEN hit THEN '999999' ELSE c_name END AS c_name, CASE WHEN hit THEN 'INVALID' ELSE c_nationkey::VARCHAR END AS c_nationkey,
  CASE WHEN hit THEN 'INVALID' ELSE c_acctbal::VARCHAR END AS c_acctbal, CASE WHEN hit THEN '999999' ELSE c_mktsegment END AS c_mktsegment FROM ({_hit_sql('customer', 'invalid', 0.1, 'c_custkey')})
""")
def degrade_invalid(spark, sf_dir):
    return D.invalid(read(spark, sf_dir, "customer"), ["c_custkey"], 0.1)[0]


def _format_sql(c: str) -> str:
    k = f"{_hash_sql('format|' + c, 'c_custkey')} % 5"
    return f"CASE WHEN NOT hit THEN {c}::VARCHAR ELSE CASE {k} WHEN 0 THEN ' ' || {c} WHEN 1 THEN {c} || ' ' WHEN 2 THEN replace({c}::VARCHAR, '.', ',') WHEN 3 THEN '*' || {c} || '*' ELSE upper({c}::VARCHAR) END END AS {c}"


@add("degrade_format", f"SELECT c_custkey, {_format_sql('c_name')}, {_format_sql('c_nationkey')}, {_format_sql('c_acctbal')}, {_format_sql('c_mktsegment')} FROM ({_hit_sql('customer', 'format', 0.2, 'c_custkey')})")
def degrade_format(spark, sf_dir):
    return D.formats(read(spark, sf_dir, "customer"), ["c_custkey"], 0.2)[0]


@add("degrade_duplicates", f"WITH h AS ({_hit_sql('orders', 'duplicates', 0.05, 'o_orderkey')}) SELECT * EXCLUDE (hit) FROM h UNION ALL SELECT * EXCLUDE (hit) FROM h WHERE hit")
def degrade_duplicates(spark, sf_dir):
    return D.duplicates(read(spark, sf_dir, "orders"), ["o_orderkey"], 0.05)[0]


@add("scenario_high_quality", f"""
WITH a AS (SELECT c_custkey, CASE WHEN NOT hit THEN c_name END AS c_name, CASE WHEN NOT hit THEN c_nationkey END AS c_nationkey,
  CASE WHEN NOT hit THEN c_acctbal END AS c_acctbal, CASE WHEN NOT hit THEN c_mktsegment END AS c_mktsegment
  FROM ({_hit_sql('customer', 'scenario|missing', 0.03, 'c_custkey')}))
SELECT c_custkey, c_name, CASE WHEN hit THEN c_nationkey * 5 ELSE c_nationkey END AS c_nationkey, CASE WHEN hit THEN c_acctbal * 5 ELSE c_acctbal END AS c_acctbal, c_mktsegment
FROM ({_hit_sql('a', 'scenario|outliers', 0.01, 'c_custkey')})
""")
def scenario_high_quality(spark, sf_dir):
    return D.scenario(read(spark, sf_dir, "customer"), ["c_custkey"], D.SCENARIOS["high_quality"])[0]


@add("scenario_low_quality_truth", " UNION ALL ".join(
    f"SELECT '{issue}' AS issue, c_custkey::VARCHAR AS \"row\", c AS \"column\" FROM ({_hit_sql('customer', 'scenario|' + step, share, 'c_custkey')}), (SELECT unnest({list(names)}) AS c) WHERE hit"
    for issue, step, share, names in (
        ("missing", "missing", 0.20, ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("outliers", "outliers", 0.05, ("c_nationkey", "c_acctbal")),
        ("invalid", "invalid", 0.10, ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), ("format", "formats", 0.02, ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
))
def scenario_low_quality_truth(spark, sf_dir):
    return D.scenario(read(spark, sf_dir, "customer"), ["c_custkey"], D.SCENARIOS["low_quality"])[1]


def _degraded(spark, sf_dir):
    return D.missing(read(spark, sf_dir, "orders"), ["o_orderkey"], 0.1)[0]


_NULLS = " + ".join(f"CASE WHEN {c} IS NULL{' OR ' + c + chr(32) + '= ' + chr(39) * 2 if c in ('o_orderstatus', 'o_orderpriority') else ''} THEN 1 ELSE 0 END" for c in _ORDERS)


@add("anomaly_missing_t1", f"SELECT o_orderkey FROM ({_MISSING_SQL}) WHERE {_NULLS} >= 1")
def anomaly_missing_t1(spark, sf_dir):
    return A.missing_rows(_degraded(spark, sf_dir), 1).select("o_orderkey")


@add("anomaly_missing_t5", f"SELECT o_orderkey FROM ({_MISSING_SQL}) WHERE {_NULLS} >= 5")
def anomaly_missing_t5(spark, sf_dir):
    return A.missing_rows(_degraded(spark, sf_dir), 5).select("o_orderkey")


# profiles


@add("profile_missing_ratio", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS missing_ratio FROM ({_MISSING_SQL})" for c in _ORDERS))
def profile_missing_ratio(spark, sf_dir):
    return P.missing_ratios(_degraded(spark, sf_dir))


_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@add("profile_numeric_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(stddev_samp({c}), 6) AS std, count(*) FILTER (WHERE {c} = 0)::BIGINT AS zeros FROM lineitem"
    for c in _LINE_NUMBERS))
def profile_numeric_stats(spark, sf_dir):
    out = P.numeric_stats(read(spark, sf_dir, "lineitem"))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


def _top_sql(table: str, columns: tuple[str, ...], key: str) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", u::BIGINT AS unique_count, r::INT AS rank, v AS value, n::BIGINT AS "count" FROM (
  SELECT v, n, count(*) OVER () AS u, row_number() OVER (ORDER BY n DESC, v) AS r FROM (
    SELECT {c} AS v, count(*) AS n FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 10000) GROUP BY {c})) WHERE r <= 3""" for c in columns)


@add("profile_text_top3_orders", _top_sql("orders", ("o_orderstatus", "o_orderpriority"), "o_orderkey"))
def profile_text_top3_orders(spark, sf_dir):
    return P.text_stats(read(spark, sf_dir, "orders"), ["o_orderkey"])


@add("profile_text_top3_part", _top_sql("part", ("p_name", "p_brand", "p_type"), "p_partkey"))
def profile_text_top3_part(spark, sf_dir):
    return P.text_stats(read(spark, sf_dir, "part"), ["p_partkey"])


@add("profile_categorical_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", n_unique FROM (SELECT count(DISTINCT {c})::BIGINT AS n_unique, count(*) AS n FROM {t}) WHERE n_unique / n < 0.05 AND n_unique < 100"
    for t, cs in (("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")), ("events", ("event_id", "user_id", "event_type", "props"))) for c in cs))
def profile_categorical_columns(spark, sf_dir):
    parts = [P.categorical_columns(read(spark, sf_dir, t)).select(F.lit(t).alias("table"), "column", "n_unique") for t in ("lineitem", "events")]
    return parts[0].unionByName(parts[1])


_COLS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@add("profile_shape", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows, {n}::BIGINT AS cols FROM {t}" for t, n in _COLS.items()))
def profile_shape(spark, sf_dir):
    out = None
    for t in TABLES:
        part = P.shape(read(spark, sf_dir, t), t)
        out = part if out is None else out.unionByName(part)
    return out


@add("report_totals", "SELECT count(*)::BIGINT AS tables, sum(rows)::BIGINT AS rows, sum(cols)::BIGINT AS cols FROM (" + " UNION ALL ".join(f"SELECT count(*) AS rows, {n} AS cols FROM {t}" for t, n in _COLS.items()) + ")")
def report_totals(spark, sf_dir):
    from .sources.sinks import totals_frame

    return totals_frame(profile_shape(spark, sf_dir))


@add("limit_preview", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5")
def limit_preview(spark, sf_dir):
    return P.preview(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"])


@add("row_index", "SELECT count(*)::BIGINT AS rows, min(i)::BIGINT AS first, max(i)::BIGINT AS last, count(DISTINCT i)::BIGINT AS distinct_rows FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def row_index(spark, sf_dir):
    df = with_row_index(read(spark, sf_dir, "lineitem").select("l_orderkey"))
    return df.agg(F.count("*").alias("rows"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"), F.count_distinct("row_idx").alias("distinct_rows"))


@add("nested_columns", "SELECT column_name AS \"column\" FROM (DESCRIBE embeddings) WHERE column_type LIKE '%[%' OR column_type LIKE 'STRUCT%' OR column_type LIKE 'MAP%'")
def nested_columns(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in P.nested_columns(read(spark, sf_dir, "embeddings"))], "column string")


# types

#: The patterns as DuckDB writes them.
_PATTERNS = {k: p.replace("(?s)", "") for k, p in SEMANTIC_TYPES.items()}


def _types_sql(columns: tuple[tuple[str, str, str], ...]) -> str:
    parts = []
    for t, c, key in columns:
        cases = " ".join(f"WHEN avg(CASE WHEN regexp_matches(trim(v), '{p}') THEN 1.0 ELSE 0.0 END) > 0.5 THEN '{k}'" for k, p in _PATTERNS.items())
        parts.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CASE {cases} END AS semantic_type FROM (SELECT {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY {key} LIMIT 200)")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE semantic_type IS NOT NULL"


@add("semantic_types", _types_sql((("pages", "url", "page_id"), ("pages", "html", "page_id"), ("documents", "text", "doc_id"), ("documents", "lang", "doc_id"), ("documents", "source", "doc_id"), ("events", "event_type", "event_id"))))
def semantic_types_query(spark, sf_dir):
    out = None
    for t, key, names in (("pages", "page_id", ("url", "html")), ("documents", "doc_id", ("text", "lang", "source")), ("events", "event_id", ("event_type",))):
        part = semantic_types(read(spark, sf_dir, t).select(key, *names), [key]).select(F.lit(t).alias("table"), "column", "semantic_type")
        out = part if out is None else out.unionByName(part)
    return out


def _text_types_sql(table: str, key: str, columns: dict[str, str]) -> str:
    parts = []
    for c, v in columns.items():
        cases = " ".join(f"WHEN avg(CASE WHEN regexp_matches(trim(v), '{p}') THEN 1.0 ELSE 0.0 END) > 0.5 THEN '{k}'" for k, p in _PATTERNS.items())
        parts.append(f"SELECT '{c}' AS \"column\", CASE {cases} END AS semantic_type FROM (SELECT {v} AS v FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} LIMIT 200)")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE semantic_type IS NOT NULL"


@add("semantic_types_orders_text", _text_types_sql("orders", "o_orderkey", {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_totalprice": "printf('%.2f', o_totalprice)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority": "o_orderpriority"}))
def semantic_types_orders_text(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    text = df.select("o_orderkey", *[F.col(c).cast("string").alias(c + "_t") for c in ("o_orderkey", "o_custkey")], F.format_string("%.2f", "o_totalprice").alias("o_totalprice_t"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_t"), F.col("o_orderpriority").alias("o_orderpriority_t"))
    return semantic_types(text, ["o_orderkey"]).select(F.regexp_replace("column", "_t$", "").alias("column"), "semantic_type")


@add("value_hints", "SELECT 'url' AS \"column\", 'URL' AS hint, avg(CASE WHEN regexp_matches(trim(v), '(?i)^(https?://|www\\.)') THEN 1.0 ELSE 0.0 END)::DOUBLE AS share, 0.03::DOUBLE AS boost FROM (SELECT url AS v FROM pages ORDER BY page_id LIMIT 200) UNION ALL SELECT 'page_id', 'numeric', 1.0, 0.0")
def value_hints_query(spark, sf_dir):
    return value_hints(read(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"]).where("share > 0").withColumn("boost", F.col("boost").cast("double"))


@add("refine_orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderkey % 2 = 0 AS flag FROM orders")
def refine_orders(spark, sf_dir):
    df = read(spark, sf_dir, "orders")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")], F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("No").alias("flag"))
    return R.refined(text)


@add("refine_types", "SELECT c AS \"column\", CASE WHEN bool_and(v IN ('0', '1')) THEN 'boolean' WHEN bool_and(try_cast(v AS BIGINT) IS NOT NULL) THEN 'bigint' WHEN bool_and(try_cast(v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type FROM (UNPIVOT (SELECT doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels) ON doc_id, quality, toxic INTO NAME c VALUE v) WHERE v IS NOT NULL AND v <> '' GROUP BY c")
def refine_types(spark, sf_dir):
    df = read(spark, sf_dir, "labels").select(*[F.col(c).cast("string").alias(c) for c in ("doc_id", "quality", "toxic")])
    return spark.createDataFrame(list(R.inferred(df).items()), "column string, type string")


@add("enforce_schema", "SELECT o_orderkey, round_even(o_totalprice, 0)::BIGINT AS o_totalprice, o_orderdate FROM orders")
def enforce_schema(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_string("%.2f", "o_totalprice")).alias("o_totalprice"), F.col("o_orderdate").cast("string").alias("o_orderdate"))
    return R.enforce(df, {"o_totalprice": "int", "o_orderdate": "datetime"})


@add("enforce_numbers", "SELECT c_custkey, round_even(c_acctbal * 123456.0, 0)::BIGINT AS big, c_acctbal / 1e9 AS small, c_custkey::DOUBLE AS whole FROM customer")
def enforce_numbers(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * F.lit(123456.0)).alias("big"), (F.col("c_acctbal") / F.lit(1e9)).alias("small"), F.col("c_custkey").alias("whole"))
    return R.enforce(df, {"big": "int", "small": "float", "whole": "float"})


# sources: tables are written in a format, scanned and read back


def _scanned(spark: SparkSession, df: DataFrame, name: str, kind: str, suffix: str | None = None) -> DataFrame:
    """``df`` written in the scratch folder as files of a format, all of which are read."""
    path = f"{scratch(spark)}/{name}.{suffix or kind}"
    write(df, path, kind)
    return read_file(spark, path).select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


@add("scan_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_csv(spark, sf_dir):
    return _scanned(spark, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "orders", "csv")


@add("scan_json_lines", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_json_lines(spark, sf_dir):
    return _scanned(spark, read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "supplier", "json")


@add("scan_json_array", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def scan_json_array(spark, sf_dir):
    return _scanned(spark, read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer", "json_array", "json")


@add("scan_parquet_folder", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def scan_parquet_folder(spark, sf_dir):
    top = scratch(spark)
    write(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), f"{top}/deep/part.parquet", "parquet")
    return next(iter(LocalFiles(spark, top).datasets())).df


@add("scan_read_errors", "SELECT 'bad.parquet (read_error)' AS name, true AS failed UNION ALL SELECT 'good.parquet', false")
def scan_read_errors(spark, sf_dir):
    top = scratch(spark)
    write(read(spark, sf_dir, "region"), f"{top}/good.parquet", "parquet")
    spark.range(1).select(F.lit("no parquet").alias("value")).coalesce(1).write.text(f"{top}/bad.parquet")
    return spark.createDataFrame([(d.name, d.error is not None) for d in LocalFiles(spark, top).datasets()], "name string, failed boolean")


@add("sql_source_limit", "SELECT count(*)::BIGINT AS rows FROM (SELECT * FROM orders LIMIT 7)")
def sql_source_limit(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    (found,) = SqlSource(spark, query="SELECT * FROM orders", max_rows=7).datasets()
    return found.df.agg(F.count("*").alias("rows"))


@add("sql_source_error", "SELECT 'bad (error)' AS name, true AS failed, 1::BIGINT AS rows UNION ALL SELECT 'good', false, count(*)::BIGINT FROM orders")
def sql_source_error(spark, sf_dir):
    """A query of a column that a table lacks, and one that it has."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    found = [d for name, column in (("bad", "no_such_column"), ("good", "o_orderkey")) for d in SqlSource(spark, query=f"SELECT {column} FROM orders", name=name).datasets()]
    return spark.createDataFrame([(d.name, d.error is not None, d.df.count()) for d in found], "name string, failed boolean, rows long")


@add("analyze_report", """
SELECT 'supplier' AS name, count(*)::BIGINT AS rows, 3::BIGINT AS cols, avg(s_acctbal) AS mean, min(s_acctbal) AS low, max(s_acctbal) AS high,
  (SELECT count(*) FROM supplier, (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS d FROM supplier) WHERE abs((s_acctbal - m) / d) > 1.5)::BIGINT AS zscore FROM supplier
""")
def analyze_report(spark, sf_dir):
    """A whole run: source, refinement, profile and detection of one table, as a report."""
    top = scratch(spark)
    write(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", "s_acctbal"), f"{top}/supplier.parquet", "parquet")
    config = AnomalyConfig(use_iqr=False, use_isolation_forest=False, use_categorical=False, use_missing=False, z_threshold=1.5)
    (d,) = analyze(LocalFiles(spark, top), config)["datasets"]
    stats = d["statistics"]["numeric_stats"]["s_acctbal"]
    # the key is refined to a number, whose scores stay below the bound of its own column only in part
    at = spark.createDataFrame([(d["name"].removesuffix(".parquet"), d["rows"], d["cols"], stats["mean"], stats["min"], stats["max"])], "name string, rows long, cols long, mean double, low double, high double")
    keys = A.zscore(R.refined(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s_suppkey"))), "s_suppkey", 1.5).count()
    return at.withColumn("zscore", F.lit(d["anomalies"]["zscore"] - keys).cast("long"))


@add("catalog_scan", "SELECT 'region' AS \"table\", count(*)::BIGINT AS rows FROM region UNION ALL SELECT 'nation_x', count(*)::BIGINT FROM nation")
def catalog_scan(spark, sf_dir):
    """A schema whose tables are found and read."""
    schema = "scan_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{scratch(spark)}'")
    for t, name in (("region", "region"), ("nation", "nation_x")):
        top = f"{scratch(spark)}/{t}"
        write(read(spark, sf_dir, t), top, "parquet")
        promote(spark, (schema, name), top)
    out = [(d.name.removeprefix(schema + "."), d.df.count()) for d in SqlSource(spark, schema=schema).datasets()]
    for t, _ in out:
        drop(spark, (schema, t))
    spark.sql(f"DROP DATABASE {schema} CASCADE")
    return spark.createDataFrame(out, "table string, rows long")


@add("drawn_duplicates", "SELECT count(*) + (count(*) * 0.05)::BIGINT AS rows, (count(*) * 0.05)::BIGINT AS drawn, true AS in_range FROM customer")
def drawn_duplicates(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    out, truth = D.drawn_duplicates(df, 0.05)
    n = df.count()
    return truth.agg(F.count("*").alias("drawn"), F.every((F.col("source_row") < n) & (F.col("row") >= n)).alias("in_range")).withColumn("rows", F.lit(out.count()).cast("long"))


# names and mapping

_COLUMNS_SQL = "SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")"
#: Every column's name, written in the ways of the mapping benchmark: (transform, field, name).
WRITTEN_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS transform, f AS field, {text} AS name FROM fields"
    for name, text in {
        "exact": "f", "case_upper": "upper(f)", "case_mixed": "array_to_string(list_transform(string_split(f, '_'), lambda w: upper(w[1]) || w[2:]), '_')",
        "synonym": "CASE f " + " ".join(f"WHEN '{k}' THEN '{min(v)}'" for k, v in B.FIELD_SYNONYMS.items()) + " ELSE f END",
        "prefix": f"'{B.PREFIX}' || f", "suffix": f"f || '{B.SUFFIX}'",
        "fuzzy_typo": "CASE WHEN length(f) > 3 THEN substr(f, 1, length(f) // 2 - 1) || substr(f, length(f) // 2 + 1, 1) || substr(f, length(f) // 2, 1) || substr(f, length(f) // 2 + 2) ELSE f END",
    }.items()
)


def written_sql(tables=TABLES) -> str:
    """``WRITTEN_SQL`` of the columns of tables."""
    return f"WITH fields(f) AS (SELECT DISTINCT c FROM ({_COLUMNS_SQL}) WHERE t IN ({', '.join(f"'{t}'" for t in tables)})) {WRITTEN_SQL}"


def columns_of_tables(spark: SparkSession, sf_dir: str, tables=TABLES) -> list[str]:
    return sorted({c for t in tables for c in read(spark, sf_dir, t).columns})


def written_columns(spark: SparkSession, sf_dir: str, tables=TABLES) -> DataFrame:
    """(transform, field, name) of the columns of tables."""
    return B.written_names(spark.createDataFrame([(c,) for c in columns_of_tables(spark, sf_dir, tables)], "field string"))


def sources_sql(written: str) -> str:
    return f"SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS place, name, false AS is_number, NULL::VARCHAR AS detected FROM (SELECT DISTINCT name FROM ({written}))"


_CLEAN_SQL, _NORM_SQL, _TOKENS_SQL = clean_sql("n"), normalized_sql("n"), tokens_sql("n")
_WRITTEN_NAMES = f"(SELECT DISTINCT name AS n FROM ({written_sql()}))"


@add("normalize_names", f"SELECT n AS name, {_CLEAN_SQL} AS cleaned, {_NORM_SQL} AS normalized, array_to_string({_TOKENS_SQL}, ' ') AS tokens FROM {_WRITTEN_NAMES}")
def normalize_names(spark, sf_dir):
    df = written_columns(spark, sf_dir).select("name").distinct()
    return df.select("name", clean(F.col("name")).alias("cleaned"), normalized(F.col("name")).alias("normalized"), F.array_join(tokens(F.col("name")), " ").alias("tokens"))


_FIELDS = ("email", "phone", "name", "address", "price", "date", "comment", "id", "l_tax")
_SYN_VALUES = ", ".join(f"('{k}', {v!r})" for k, v in M.SYNONYMS.items())


@add("mapping_components", f"""
WITH s AS (SELECT n AS source, {_NORM_SQL} AS src_n, {_TOKENS_SQL} AS src_t FROM {_WRITTEN_NAMES}),
r AS (SELECT n AS ref, {_NORM_SQL} AS ref_n, {_TOKENS_SQL} AS ref_t, COALESCE(y.a, []) AS aliases FROM (VALUES {', '.join(f"('{f}')" for f in _FIELDS)}) t(n) LEFT JOIN (VALUES {_SYN_VALUES}) y(k, a) ON y.k = n),
x AS (SELECT *, list_transform(aliases, lambda n: {_NORM_SQL}) AS alias_n FROM r)
SELECT source, ref, (CASE WHEN source = ref THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact, (CASE WHEN src_n = ref_n THEN 0.98 ELSE 0.0 END)::DOUBLE AS norm_exact,
  (CASE WHEN list_contains(aliases, source) OR list_contains(alias_n, src_n) OR list_has_any(src_t, alias_n) THEN 0.97 ELSE 0.0 END)::DOUBLE AS synonym,
  COALESCE(len(list_intersect(src_t, ref_t))::DOUBLE / nullif(len(list_distinct(list_concat(src_t, ref_t))), 0), 0.0) AS jaccard,
  (CASE WHEN len(src_t) = 1 AND length(src_t[1]) <= 2 AND src_n <> ref_n THEN -0.02 ELSE 0.0 END)::DOUBLE AS length_penalty
FROM s, x
""")
def mapping_components(spark, sf_dir):
    names = [r.name for r in written_columns(spark, sf_dir).select("name").distinct().collect()]  # names of columns
    rows = M.components(M.names_only(spark, names), M.reference_names(spark, _FIELDS))
    return rows.select("source", "ref", *[F.col(c).cast("double").alias(c) for c in ("exact", "norm_exact", "synonym", "jaccard", "length_penalty")])


_DECIDED = "SELECT source, status, target, score FROM decided"


#: The columns of orders, as the references of its own columns, and the tables whose columns are mapped onto fields.
_ORDER_FIELDS, _MAPPED_TABLES = _ORDERS, ("customer", "supplier", "documents")


@add("mapping_decisions", decisions_sql(sources_sql(written_sql(_MAPPED_TABLES)), _FIELDS, M.SYNONYMS, 0.7, 0.05) + _DECIDED)
def mapping_decisions(spark, sf_dir):
    """Columns of three tables, however they are written, onto fields."""
    names = sorted({r.name for r in written_columns(spark, sf_dir, _MAPPED_TABLES).collect()})  # names of columns
    out = M.map_columns(None, names, _FIELDS, threshold=0.7, epsilon=0.05, spark=spark)
    return out.select("source", "status", "target", F.round("score", 6).alias("score"))


@add("mapping_candidates", decisions_sql(sources_sql(written_sql(("orders",))), _ORDER_FIELDS, M.SYNONYMS, 0.7, 0.1) + _DECIDED)
def mapping_candidates(spark, sf_dir):
    """Decisions by the candidate join of large catalogs, held against all pairs."""
    names = sorted({r.name for r in written_columns(spark, sf_dir, ("orders",)).collect()})  # names of columns
    sources, refs = M.names_only(spark, names), M.reference_names(spark, read(spark, sf_dir, "orders").columns)
    return M.decided(sources, refs, 0.7, 0.1, all_pairs=0).select("source", "status", "target", F.round("score", 6).alias("score"))


_PAGE_FIELDS = ("url", "page", "html_text")
_PAGE_SOURCES = f"""
SELECT v.place, v.name, v.name = 'page_id' AS is_number, d.semantic_type AS detected FROM ({values_sql(("page_id", "url", "html"))}) v
LEFT JOIN ({_types_sql((("pages", "url", "page_id"), ("pages", "html", "page_id")))}) d ON d."column" = v.name
"""


@add("mapping_table_decisions", decisions_sql(_PAGE_SOURCES, _PAGE_FIELDS, M.SYNONYMS, 0.5, 0.01) + _DECIDED)
def mapping_table_decisions(spark, sf_dir):
    out = M.map_columns(read(spark, sf_dir, "pages").select("page_id", "url", "html"), None, _PAGE_FIELDS, threshold=0.5, epsilon=0.01, order_by=["page_id"])
    return out.select("source", "status", "target", F.round("score", 6).alias("score"))


@add("dynamic_refs", f"SELECT DISTINCT c AS \"column\" FROM ({_COLUMNS_SQL}) WHERE t <> 'labels' AND c NOT IN (SELECT c FROM ({_COLUMNS_SQL}) WHERE t = 'labels')")
def dynamic_refs(spark, sf_dir):
    names = spark.createDataFrame([(t, c) for t in TABLES for c in read(spark, sf_dir, t).columns], "table string, column string")
    return M.dynamic_references_frame(names, "labels")


@add("schema_diff", """
WITH o AS (SELECT * FROM (VALUES ('doc_id', 'bigint'), ('quality', 'int'), ('toxic', 'int')) t(c, k)),
n AS (SELECT * FROM (VALUES ('doc_id', 'string'), ('toxic', 'int'), ('note', 'string')) t(c, k))
SELECT COALESCE(o.c, n.c) AS "column", CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'changed' END AS change, o.k AS old, n.k AS new
FROM o FULL JOIN n ON o.c = n.c WHERE o.k IS DISTINCT FROM n.k
""")
def schema_diff(spark, sf_dir):
    old = read(spark, sf_dir, "labels")
    new = old.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", F.lit("").alias("note"))
    return S.diff(S.schema_frame(old), S.schema_frame(new))


# evaluation

_PRF = """
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, p AS "precision", r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM ({}))
"""


@add("eval_anomaly_prf", f"""
WITH x AS (SELECT event_id, CASE WHEN hit THEN value * 5 ELSE value END AS value, hit FROM ({_hit_sql('events', 'outliers', 0.05, 'event_id')})),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM x), f AS (SELECT *, abs((value - m) / d) > 3.0 AS found FROM x, s)
""" + _PRF.format("SELECT count(*) FILTER (WHERE found AND hit)::DOUBLE AS tp, count(*) FILTER (WHERE found AND NOT hit)::DOUBLE AS fp, count(*) FILTER (WHERE hit AND NOT found)::DOUBLE AS fn FROM f"))
def eval_anomaly_prf(spark, sf_dir):
    df, truth = D.outliers(read(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], 0.05)
    return E.row_scores(A.zscore(df, "value").select(F.col("event_id").cast("string").alias("row")), truth)


_LABEL_TYPES = {"doc_id": "Int64", "quality": "long", "toxic": "boolean", "note": "string"}
_FAMILY_SQL = "CASE " + " ".join(f"WHEN lower({{0}}) IN {members} THEN '{name}'" for name, members in E.FAMILIES) + " ELSE lower({0}) END"


@add("eval_schema_accuracy", f"""
SELECT count(*) FILTER (WHERE ok)::BIGINT AS correct, count(*)::BIGINT AS total, (count(*) FILTER (WHERE ok) / count(*))::DOUBLE AS accuracy FROM (
  SELECT {_FAMILY_SQL.format('want')} = {_FAMILY_SQL.format('column_type')} AS ok FROM (VALUES {', '.join(map(str, _LABEL_TYPES.items()))}) t(name, want) LEFT JOIN (DESCRIBE labels) ON column_name = name)
""")
def eval_schema_accuracy(spark, sf_dir):
    found = S.schema_frame(read(spark, sf_dir, "labels"))
    return E.schema_accuracy(found, spark.createDataFrame(list(_LABEL_TYPES.items()), "column string, type string"))


def _semantic_sql(found: str, truth: dict[str, str]) -> str:
    """Scores of (column, semantic_type) rows against a truth that isn't empty."""
    return _PRF.format(f"""SELECT count(*) FILTER (WHERE f = t)::DOUBLE AS tp, count(*) FILTER (WHERE f IS NOT NULL AND f IS DISTINCT FROM t)::DOUBLE AS fp, count(*) FILTER (WHERE f IS NULL)::DOUBLE AS fn
FROM (SELECT f.semantic_type AS f, t.k AS t FROM ({found}) f FULL JOIN (VALUES {', '.join(map(str, truth.items()))}) t(c, k) ON t.c = f."column")""")


_SEMANTIC_TRUTH = {"url": "URL", "html": "Email"}


@add("eval_semantic_prf", _semantic_sql(_types_sql((("pages", "url", "page_id"), ("pages", "html", "page_id"))), _SEMANTIC_TRUTH))
def eval_semantic_prf(spark, sf_dir):
    found = semantic_types(read(spark, sf_dir, "pages"), ["page_id"])
    return E.semantic_scores(found, spark.createDataFrame(list(_SEMANTIC_TRUTH.items()), "column string, semantic_type string"))


@add("eval_semantic_empty_truth", "SELECT 0::BIGINT AS tp, count(*)::BIGINT AS fp, 0::BIGINT AS fn, 0.0::DOUBLE AS \"precision\", 1.0::DOUBLE AS recall, 0.0::DOUBLE AS f1 FROM (" + _types_sql((("pages", "url", "page_id"), ("pages", "html", "page_id"))) + ")")
def eval_semantic_empty_truth(spark, sf_dir):
    found = semantic_types(read(spark, sf_dir, "pages"), ["page_id"])
    return E.semantic_scores(found, spark.createDataFrame([], "column string, semantic_type string"))


@add("eval_mapping_accuracy", decisions_sql(sources_sql(written_sql(("orders",))), _ORDER_FIELDS, M.SYNONYMS, 0.6, 0.4) + f"""
SELECT sum(p)::DOUBLE AS score, count(*)::BIGINT AS total, (sum(p) / count(*))::DOUBLE AS accuracy FROM (
  SELECT CASE WHEN status = 'mapped' AND target = want THEN 1.0 WHEN status = 'ambiguous' AND list_contains(candidates, want) THEN 0.5 ELSE 0.0 END AS p
  FROM (SELECT DISTINCT name, field AS want FROM ({written_sql(("orders",))})) t LEFT JOIN decided ON source = name)
""")
def eval_mapping_accuracy(spark, sf_dir):
    """The columns of orders, however they are written, onto themselves."""
    truth = written_columns(spark, sf_dir, ("orders",)).select(F.col("name").alias("source"), F.col("field").alias("target")).distinct()
    names = sorted(r.source for r in truth.select("source").collect())  # names of columns
    decided = M.map_columns(None, names, read(spark, sf_dir, "orders").columns, threshold=0.6, epsilon=0.4, spark=spark)
    return E.mapping_accuracy(decided, truth)


@add("eval_end_to_end")
def eval_end_to_end(spark, sf_dir):
    return V.end_to_end({"supplier": (read(spark, sf_dir, "supplier"), ["s_suppkey"])})


@add("eval_scenario_averages", """
SELECT lang AS scenario, count(*)::BIGINT AS tables, round(avg(a), 6) AS anomaly_f1, round(avg(s), 6) AS schema_accuracy, round(avg(m), 6) AS semantic_f1, round(avg(1 - s), 6) AS mapping_accuracy
FROM (SELECT source, lang, avg(quality) AS a, avg(toxic) AS s, CASE WHEN source <> 'web' THEN avg(quality) END AS m FROM documents JOIN labels USING (doc_id) GROUP BY source, lang) GROUP BY lang
""")
def eval_scenario_averages(spark, sf_dir):
    """Shares of labels by source and language as the scores of tables and scenarios, some of which lack one."""
    both = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("table"), F.col("lang").alias("scenario")).join(read(spark, sf_dir, "labels"), "doc_id")
    rows = both.groupBy("table", "scenario").agg(F.avg("quality").alias("anomaly_f1"), F.avg("toxic").alias("schema_accuracy"))
    rows = rows.withColumns({"semantic_f1": F.when(F.col("table") != "web", F.col("anomaly_f1")), "mapping_accuracy": 1 - F.col("schema_accuracy")})
    return E.scenario_averages(rows).select("scenario", "tables", *[F.round(m, 6).alias(m) for m in E.METRICS])


# SQL that is passed through

SQL = {
    "agg": "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, CAST(round(avg(l_extendedprice), 4) AS DOUBLE) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "join": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "outer": "SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey < 10 GROUP BY r_name",
    "window": "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) t WHERE rank <= 2",
    "setops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 0",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "semi_anti": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderstatus = 'P')",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "distinct": "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS returns FROM lineitem",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "range_join": "SELECT count(*) AS n FROM part p JOIN (SELECT min(p_retailprice) AS lo, avg(p_retailprice) AS hi FROM part) b ON p.p_retailprice BETWEEN b.lo AND b.hi",
    "right_join": "SELECT r_name, n_name FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n RIGHT JOIN region ON r_regionkey = n_regionkey AND n_nationkey < 9",
    "full_join": "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey % 3 > 0) c FULL JOIN supplier ON c_custkey = s_suppkey",
    "cube": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "frames": "SELECT event_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS day_high, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS quarter FROM events",
    "setops_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier UNION ALL (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey AS k FROM nation)",
    "scalars": "SELECT o_orderkey, year(o_orderdate) AS y, upper(substr(o_orderpriority, 3)) AS p, round(o_totalprice / 7, 3) AS r, coalesce(nullif(o_orderstatus, 'F'), 'done') AS s, length(concat(o_orderstatus, '-', o_orderpriority)) AS n, greatest(o_custkey, 500) AS g, date_trunc('month', o_orderdate) AS m FROM orders",
    "subquery": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)",
}


def _passed(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
        return query(spark, sql)

    return run


for _name, _sql in SQL.items():
    add(f"sql_passthrough_{_name}", _sql)(_passed(_sql))


# benchmarks


@add("benchmark_anomalies")
def benchmark_anomalies(spark, sf_dir):
    """All detectors on degraded variants of the parts."""
    return B.anomaly_benchmark(spark, clean=read(spark, sf_dir, "part"), keys=["p_partkey"])
