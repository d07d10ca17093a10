"""Queries of as-of and interval joins, of order statistics, and of detectors and degradations on values that are hard to get right."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.order import quantiles
from .functions.types import with_row_index
from .operators import anomalies as A
from .operators import degrade as D
from .operators import profile as P
from .operators.joins import asof_join, interval_join
from .plans.assistant import flagged_rows
from .plans.config import AnomalyConfig
from .queries import _hash_sql, add, read
from .sources.catalog import import_tables
from .sources.databases import derby_database
from .sources.files import scratch
from .sources.sinks import MANIFEST, write

# joins


@add("asof_events_previous", """
SELECT e.event_id, p.event_id AS previous_id, p.event_type AS previous_type, p.value AS previous_value
FROM events e ASOF LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) p ON e.user_id = p.user_id AND e.ts > p.ts
""")
def asof_events_previous(spark, sf_dir):
    """Every event with the user's last event before it."""
    events = read(spark, sf_dir, "events")
    out = asof_join(events, events, "ts", ["user_id"], strict=True)
    return out.select("event_id", F.col("matched.event_id").alias("previous_id"), F.col("matched.event_type").alias("previous_type"), F.col("matched.value").alias("previous_value"))


@add("asof_orders_shipments", """
SELECT o.o_orderkey, l.l_linenumber, l.l_shipdate FROM orders o
ASOF LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_shipdate ORDER BY l_linenumber DESC) = 1) l ON o.o_orderkey = l.l_orderkey AND o.o_orderdate <= l.l_shipdate
""")
def asof_orders_shipments(spark, sf_dir):
    """Every order with its first line that ships on the order's day or later; the largest number of those of one day."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    out = asof_join(read(spark, sf_dir, "orders"), lines, ("o_orderdate", "l_shipdate"), [("o_orderkey", "l_orderkey")], "forward", ties=["l_linenumber"])
    return out.select("o_orderkey", "matched.l_linenumber", "matched.l_shipdate")


@add("asof_events_odd", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN user_id % 3 END AS k, CASE WHEN event_id % 11 > 0 THEN date_trunc('hour', ts) END AS t FROM events),
r AS (SELECT k, t, max(event_id) AS id FROM x WHERE event_id % 2 = 0 AND k IS NOT NULL AND t IS NOT NULL GROUP BY k, t)
SELECT x.event_id, CASE WHEN r.t >= x.t - INTERVAL 3 HOUR THEN r.id END AS match_id FROM x ASOF LEFT JOIN r ON x.k = r.k AND x.t >= r.t
""")
def asof_events_odd(spark, sf_dir):
    """Null keys and times, three keys that have all rows, many equal times, and a tolerance."""
    x = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 > 0, F.col("user_id") % 3).alias("k"), F.when(F.col("event_id") % 11 > 0, F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("t"))
    out = asof_join(x, x.where("event_id % 2 = 0"), "t", ["k"], tolerance=F.expr("INTERVAL 3 HOURS"), bucket_rows=1 << 10)
    return out.select("event_id", F.col("matched.event_id").alias("match_id"))


@add("interval_join_events", """
WITH x AS (SELECT event_id, user_id, ts, ts + INTERVAL 1 HOUR AS long_end, ts + INTERVAL 10 MINUTE AS short_end FROM events)
SELECT a.event_id AS left_id, b.event_id AS right_id FROM x a JOIN x b ON a.user_id = b.user_id AND a.ts <= b.short_end AND b.ts <= a.long_end
""")
def interval_join_events(spark, sf_dir):
    """Hours after events and ten minutes after events of the same user that overlap."""
    x = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr("ts + INTERVAL 1 HOUR").alias("long_end"), F.expr("ts + INTERVAL 10 MINUTES").alias("short_end"))
    return interval_join(x, x, ("ts", "long_end"), ("ts", "short_end"), ["user_id"]).select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@add("interval_join_prices", """
SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice * 0.99::DOUBLE <= s_acctbal + 25.0::DOUBLE AND s_acctbal - 25.0::DOUBLE <= p_retailprice * 1.01::DOUBLE
""")
def interval_join_prices(spark, sf_dir):
    """Parts and suppliers whose ranges of price and balance overlap; there is no key."""
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 0.99).alias("a"), (F.col("p_retailprice") * 1.01).alias("b"))
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25.0).alias("a"), (F.col("s_acctbal") + 25.0).alias("b"))
    return interval_join(part, supplier, ("a", "b"), ("a", "b")).select("left.p_partkey", "right.s_suppkey")


@add("range_join_shipments", """
SELECT o_orderkey, l_linenumber, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 400 DAY
""")
def range_join_shipments(spark, sf_dir):
    """Lines that ship within 400 days of their order: instants in intervals."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + INTERVAL 400 DAYS").alias("until"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    out = interval_join(orders, lines, ("o_orderdate", "until"), ("l_shipdate", "l_shipdate"), [("o_orderkey", "l_orderkey")])
    return out.select("left.o_orderkey", "right.l_linenumber", "right.l_shipdate")


@add("row_index_stable", """
WITH x AS (SELECT row_number() OVER () - 1 AS row_idx, * FROM lineitem)
SELECT row_idx::BIGINT AS row_idx, l_orderkey, l_linenumber, l_extendedprice FROM x
""")
def row_index_stable(spark, sf_dir):
    """Numbers of a table's rows, taken before and after its rows were dealt out anew, that still meet each other."""
    lines = read(spark, sf_dir, "lineitem")
    before, after = with_row_index(lines.select("l_orderkey", "l_linenumber")), with_row_index(lines.select("l_extendedprice").repartition(7))
    return before.join(after, "row_idx").select("row_idx", "l_orderkey", "l_linenumber", "l_extendedprice")


_ROWS_SQL = " UNION ALL ".join([
    *[f"SELECT i AS row_idx, '{c}' AS \"column\", 'zscore' AS method FROM x, (SELECT avg({c}) AS m, stddev_pop({c}) AS d FROM x) WHERE d > 0 AND abs(({c} - m) / d) > 2.0" for c in ("user_id", "value")],
    *[f"SELECT i, '{c}', 'iqr' FROM x, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS b FROM x) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)" for c in ("user_id", "value")],
    "SELECT i, NULL, 'categorical' FROM x WHERE event_type IN (SELECT event_type FROM x GROUP BY event_type HAVING count(*) < 0.01 * (SELECT count(*) FROM x))",
    "SELECT i, NULL, 'missing_values' FROM x WHERE value IS NULL OR event_type IS NULL OR event_type = ''",
])


@add("flagged_rows_all", f"""
WITH x AS (SELECT row_number() OVER () - 1 AS i, user_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 211 = 0 THEN 'odd' ELSE event_type END AS event_type FROM events)
SELECT row_idx::BIGINT AS row_idx, "column", method FROM ({_ROWS_SQL})
""")
def flagged_rows_all(spark, sf_dir):
    """Every flagged row of every method and column, as the table that a run stores."""
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("")).when(F.col("event_id") % 211 == 0, F.lit("odd")).otherwise(F.col("event_type"))
    df = with_row_index(read(spark, sf_dir, "events")).select("row_idx", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), kind.alias("event_type"))
    return flagged_rows(df, AnomalyConfig(z_threshold=2.0, use_isolation_forest=False)).rows


# writers and imports


@add("json_array_round_trip", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def json_array_round_trip(spark, sf_dir):
    """A table as arrays of records, one a file, and back."""
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice").repartition(3)
    path = f"{scratch(spark)}/orders"
    write(df, path, "json_array")
    return spark.read.option("multiLine", True).json(path).select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns])


@add("manifest_files", "SELECT s_suppkey, s_name FROM supplier")
def manifest_files(spark, sf_dir):
    """The files that a manifest lists hold the table, also after it was written over."""
    path = f"{scratch(spark)}/supplier"
    for parts in (4, 2):
        write(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").repartition(parts), path, "delta")
    files = [r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()]  # a row a file
    return spark.read.parquet(*files)


@add("jdbc_import", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def jdbc_import(spark, sf_dir):
    """A table put into a database, and read back over JDBC by several tasks, on whatever executors."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    url = derby_database(df, "customer")
    (path,) = import_tables(spark, url, ["customer"], scratch(spark), rows=max(1, df.count() // 5))
    out = spark.read.parquet(path)
    return out.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


# order statistics and values that are no plain numbers

_SHARES = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
_ODD = "CASE event_id % 50 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL WHEN 4 THEN -value ELSE value END"


def _odd(df):
    at = F.col("event_id") % 50
    value = F.when(at == 0, F.lit(float("inf"))).when(at == 1, F.lit(float("-inf"))).when(at == 2, F.lit(float("nan"))).when(at == 3, F.lit(None)).when(at == 4, -F.col("value")).otherwise(F.col("value"))
    return df.select("event_id", value.alias("value"))


def _quantile_rows(name: str, values: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, {s}::DOUBLE AS share, quantile_cont({values}, {s}) AS value FROM {source} WHERE NOT isnan({values})" for s in _SHARES)


@add("quantiles_exact", " UNION ALL ".join([
    _quantile_rows("odd", "value", f"(SELECT {_ODD} AS value FROM events)"), _quantile_rows("price", "l_extendedprice", "lineitem"), _quantile_rows("quantity", "l_quantity", "lineitem"),
]))
def quantiles_exact(spark, sf_dir):
    """Ranks by radix selection, with infinite values, of columns with many and with few distinct values."""
    rows = []
    lines = read(spark, sf_dir, "lineitem")
    for df, values in ((_odd(read(spark, sf_dir, "events")), {"odd": F.col("value")}), (lines, {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")})):
        rows += [(name, share, v) for name, found in quantiles(df, values, _SHARES).items() for share, v in zip(_SHARES, found, strict=True)]
    return spark.createDataFrame(rows, "name string, share double, value double")


@add("anomaly_infinite_values", f"""
WITH x AS (SELECT event_id, {_ODD} AS value FROM events), s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM x WHERE NOT isnan(value))
SELECT 'iqr' AS method, event_id FROM x, s WHERE NOT isnan(value) AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
""")
def anomaly_infinite_values(spark, sf_dir):
    """With infinite values z-scores flag nothing; quartiles are finite here and flag what is beyond their bounds."""
    odd = _odd(read(spark, sf_dir, "events"))
    return A.zscore(odd, "value").select(F.lit("zscore").alias("method"), "event_id").unionByName(A.iqr(odd, "value").select(F.lit("iqr").alias("method"), "event_id"))


@add("anomaly_infinite_quartiles", "SELECT event_id, value FROM events WHERE false")
def anomaly_infinite_quartiles(spark, sf_dir):
    """Where a quartile itself is infinite there are no bounds, and nothing is flagged."""
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("value"))
    return A.iqr(df, "value")


@add("profile_nan", f"""
SELECT 'value' AS "column", true AS nan_mean, min(value) FILTER (WHERE NOT isnan(value)) AS low, max(value) FILTER (WHERE NOT isnan(value)) AS high, (count(*) FILTER (WHERE value = 0))::BIGINT AS zeros
FROM (SELECT CASE WHEN isinf(value) THEN 0.0 ELSE value END AS value FROM (SELECT {_ODD} AS value FROM events))
""")
def profile_nan(spark, sf_dir):
    odd = _odd(read(spark, sf_dir, "events")).select(F.when(F.abs("value") == float("inf"), 0.0).otherwise(F.col("value")).alias("value"))
    return P.numeric_stats(odd).select("column", F.isnan("mean").alias("nan_mean"), F.col("min").alias("low"), F.col("max").alias("high"), "zeros")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@add("degrade_repeated_keys", f"""
SELECT l_orderkey, CASE WHEN NOT hit THEN l_linenumber END AS l_linenumber, CASE WHEN NOT hit THEN l_partkey END AS l_partkey, CASE WHEN NOT hit THEN l_suppkey END AS l_suppkey, CASE WHEN NOT hit THEN l_returnflag END AS l_returnflag
FROM (SELECT *, row_number() OVER (ORDER BY {_hash_sql('missing', 'l_orderkey')}, {_hash_sql('missing|row', *_LINE)}) <= floor(count(*) OVER () * 0.07::DOUBLE) AS hit FROM lineitem)
""")
def degrade_repeated_keys(spark, sf_dir):
    """Exactly int(rows * share) rows also where several have one key."""
    return D.missing(read(spark, sf_dir, "lineitem").select(*_LINE), ["l_orderkey"], 0.07)[0]


@add("degrade_equal_rows", """
SELECT c_nationkey, CASE WHEN i > n THEN c_mktsegment END AS c_mktsegment, count(*) AS rows FROM (
  SELECT c_nationkey, c_mktsegment, floor(count(*) OVER () * 0.3::DOUBLE) AS n,
    row_number() OVER (ORDER BY """ + _hash_sql("missing", "c_nationkey") + ", " + _hash_sql("missing|row", "c_nationkey", "c_mktsegment") + """) AS i FROM customer)
GROUP BY ALL
""")
def degrade_equal_rows(spark, sf_dir):
    """Rows that are equal in all columns are interchangeable; their number is exact."""
    out = D.missing(read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"), ["c_nationkey"], 0.3)[0]
    return out.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("rows"))


@add("degrade_overflow", f"""
SELECT c_custkey, CASE WHEN hit THEN least(big::HUGEINT * 5, 9223372036854775807)::BIGINT ELSE big END AS big, CASE WHEN hit THEN greatest(low::BIGINT * 5, -2147483648)::INT ELSE low END AS low
FROM (SELECT c_custkey, 9223372036854775807 - c_custkey AS big, (-500000000 + c_custkey)::INT AS low, row_number() OVER (ORDER BY {_hash_sql('outliers', 'c_custkey')}) <= floor(count(*) OVER () * 0.1::DOUBLE) AS hit FROM customer)
""")
def degrade_overflow(spark, sf_dir):
    """Integers near the limits of their types end there."""
    df = read(spark, sf_dir, "customer").select("c_custkey", (F.lit(9223372036854775807) - F.col("c_custkey")).alias("big"), (F.lit(-500000000) + F.col("c_custkey")).cast("int").alias("low"))
    return D.outliers(df, ["c_custkey"], 0.1)[0]
