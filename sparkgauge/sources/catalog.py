"""Tables of the session's catalog and SQL queries as datasets."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .files import Dataset, error_frame, file_system, limited

#: Parts of the names of variants and truths, and the name of a query's dataset.
VARIANT_MARKS = ("_quality", "_truth")
QUERY_NAME = "sql_query"


def quoted(*parts: str) -> str:
    """A name of several parts; each is quoted whole, whatever dots or quotes it holds."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def named(table: str | tuple[str, ...]) -> str:
    """A table given as parts, or as one dotted name whose parts hold no dots themselves."""
    return quoted(*(table.split(".") if isinstance(table, str) else table))


def schemas(spark: SparkSession) -> list[str]:
    """Databases, sorted; none if the catalog fails."""
    try:
        return sorted(d.name for d in spark.catalog.listDatabases())
    except Exception:  # noqa: BLE001 listing never fails
        return []


def tables(spark: SparkSession, schema: str) -> list[str]:
    try:
        return sorted(t.name for t in spark.catalog.listTables(schema) if not t.isTemporary)
    except Exception:  # noqa: BLE001 listing never fails
        return []


def source_tables(spark: SparkSession, schema: str) -> list[str]:
    """Tables that are neither variants nor truths."""
    return [t for t in tables(spark, schema) if not any(m in t for m in VARIANT_MARKS)]


def table_schema(spark: SparkSession, table: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in spark.table(table).schema.fields}


def download(spark: SparkSession, table: str, rows: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """A table's first rows and its schema; a table without columns or rows, and {}, if it can't be read."""
    try:
        return limited(spark.table(table), rows), table_schema(spark, table)
    except Exception:  # noqa: BLE001 the caller goes on without the table
        return spark.createDataFrame([], T.StructType()), {}


#: Fixed value: levels of a catalog that a search goes down.
DEPTH = 5


def namespaces(spark: SparkSession, top: str | tuple[str, ...] | None = None, depth: int = DEPTH) -> list[tuple[str, ...]]:
    """Namespaces below ``top``, or all, with their own namespaces down to ``depth`` levels, sorted; each as its parts."""
    todo: list[tuple[str, ...]] = [tuple(top.split(".")) if isinstance(top, str) else top] if top else [(s,) for s in schemas(spark)]
    out, seen = [], set(todo)
    while todo:
        space = todo.pop()
        out.append(space)
        if len(space) >= depth:
            continue
        try:
            rows = spark.sql(f"SHOW NAMESPACES IN {quoted(*space)}").collect()
        except Exception:  # noqa: BLE001 catalogs of one level have none below
            continue
        below = [(*space, r[0].split(".")[-1].strip("`")) for r in rows]
        todo += [s for s in below if s not in seen]
        seen |= set(below)
    return sorted(out)


def find(spark: SparkSession, pattern: str, schema: str | None = None, depth: int = DEPTH) -> list[tuple[str, ...]]:
    """(schema, table), with a part for each level, of all tables whose name fits a pattern with * and ?, below one schema or all."""
    return [(*s, t) for s in namespaces(spark, schema, depth) for t in tables(spark, s[0] if len(s) == 1 else quoted(*s)) if fnmatch.fnmatchcase(t, pattern)]


def at_path(spark: SparkSession, path: str, schema: str | None = None) -> tuple[str, str] | None:
    """(schema, table) of the table that lies at a path; None if there is none."""
    wanted = file_system(spark, path)[1].toUri().getPath().rstrip("/")
    for s, t in find(spark, "*", schema):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(s, t)}").where("col_name = 'Location'").collect()  # one row
        if rows and file_system(spark, rows[0].data_type)[1].toUri().getPath().rstrip("/") == wanted:
            return s, t
    return None


def query(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    """Any query of Spark SQL; the limit is put on its plan, whatever its text holds."""
    return limited(spark.sql(sql.strip().rstrip(";")), rows)


class SqlSource:
    """A query, or all tables of a schema, as datasets. The schema goes before the query; blanks count as not given."""

    def __init__(self, spark: SparkSession, query: str | None = None, schema: str | None = None, max_rows: int | None = None, name: str = QUERY_NAME):
        self.spark, self.max_rows, self.name = spark, max_rows, name
        self.query = query.strip() or None if query else None
        self.schema = schema.strip() or None if schema else None
        if not self.query and not self.schema:
            raise ValueError("Either a query or a schema must be given")

    def discover(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema) if not t.isTemporary)

    def _failed(self, name: str, e: Exception) -> Dataset:
        return Dataset(name, None, error_frame(self.spark, str(e)), str(e))

    def datasets(self) -> Iterator[Dataset]:
        if not self.schema:
            try:
                df = query(self.spark, self.query, self.max_rows)
                df.limit(1).collect()
                yield Dataset(self.name, None, df)
            except Exception as e:  # noqa: BLE001 a failing query is a dataset
                yield self._failed(f"{self.name} (error)", e)
            return
        try:
            names = self.discover()
        except Exception as e:  # noqa: BLE001 a failing discovery is a dataset
            yield self._failed(f"{self.schema} (discovery_error)", e)
            return
        for t in names:
            try:
                df = limited(self.spark.table(quoted(self.schema, t)), self.max_rows)
                df.limit(1).collect()
                yield Dataset(f"{self.schema}.{t}", None, df)
            except Exception as e:  # noqa: BLE001 one table doesn't stop the others
                yield self._failed(f"{self.schema}.{t} (error)", e)


def promote(spark: SparkSession, table: str | tuple[str, ...], path: str, kind: str = "parquet", options: dict[str, str] | None = None) -> None:
    """Files as a table of the catalog; one that is there stays."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"Unsupported format: {kind}")
    given = ", ".join(f"'{k}' '{v}'" for k, v in ({"header": "true", "inferSchema": "true"} if kind == "csv" and not options else options or {}).items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {named(table)} USING {kind}{f' OPTIONS ({given})' if given else ''} LOCATION '{path}'")


def refresh(spark: SparkSession, table: str | tuple[str, ...]) -> None:
    spark.sql(f"REFRESH TABLE {named(table)}")


def drop(spark: SparkSession, table: str | tuple[str, ...]) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {named(table)}")


def nested_variants(names: list[str]) -> list[str]:
    """Variants of variants."""
    return [n for n in names if n.count(VARIANT_MARKS[0]) > 1]


def drop_nested_variants(spark: SparkSession, schema: str) -> list[str]:
    gone = nested_variants(tables(spark, schema))
    for t in gone:
        drop(spark, (schema, t))
    return gone


#: How databases list their tables: a query for a column ``name``, by the part of the address after ``jdbc:``.
DISCOVERY = {
    "sqlite": "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
    None: "SELECT table_name AS name FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema NOT IN ('information_schema', 'pg_catalog')",
}


def discovered(spark: SparkSession, url: str, **options: str) -> list[str]:
    """Names of the tables of a database over JDBC, sorted."""
    kind = url.split(":")[1] if url.count(":") > 1 else None
    rows = spark.read.format("jdbc").options(url=url, query=DISCOVERY.get(kind, DISCOVERY[None]), **options).load()
    return sorted(r.name for r in rows.collect())  # a row per table


#: Rows that a task of an import takes, and cells of the grid from which balanced ranges are put together, for each task.
IMPORT_ROWS, CELLS = 1_000_000, 16


def _name(url: str, column: str) -> str:
    """A column's exact name in the database's SQL."""
    mark = "`" if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")) else '"'
    return mark + column.replace(mark, 2 * mark) + mark


def key_ranges(spark: SparkSession, url: str, table: str, key: str, rows: int = IMPORT_ROWS, **options: str) -> list[str]:
    """Predicates that part a table by a whole-numbered key into ranges of about ``rows`` rows; null keys go with the first.

    The database counts the keys by the cells of a grid, and neighbouring cells are put together, so that dense stretches of keys
    are parted as finely as sparse ones, down to a cell.
    """
    key = _name(url, key)
    ask = lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    low, high, n = ask(f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT(*) AS n FROM {table}").first()
    parts = -(-n // rows)
    if parts <= 1 or low is None or low == high:
        return ["1 = 1"]
    low, high = int(low), int(high)
    width = -(-(high - low + 1) // (parts * CELLS))
    counts = {int(r[0]): r[1] for r in ask(f"SELECT ({key} - {low}) / {width} AS cell, COUNT(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY ({key} - {low}) / {width}").collect()}  # CELLS rows a part
    cuts, held = [], 0
    for cell in sorted(counts):
        if held and held + counts[cell] > rows:
            cuts.append(low + cell * width)
            held = 0
        held += counts[cell]
    bounds = [None, *cuts, None]
    tests = [" AND ".join(t for t in (f"{key} >= {a}" if a is not None else "", f"{key} < {b}" if b is not None else "") if t) or "1 = 1" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"({tests[0]}) OR {key} IS NULL", *tests[1:]] if cuts else tests


def import_tables(spark: SparkSession, url: str, names: list[str] | None, out: str, rows: int = IMPORT_ROWS, **options: str) -> list[str]:
    """Tables of a database over JDBC, all unless named, each as Parquet {out}/{table}.parquet.

    A table with a whole-numbered column is read by as many tasks as it has ranges of about ``rows`` rows of the first such column.
    """
    paths = []
    for n in discovered(spark, url, **options) if names is None else names:
        path = f"{out}/{n}.parquet"
        whole = [f.name for f in spark.read.format("jdbc").options(url=url, dbtable=n, **options).load().schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]
        ranges = key_ranges(spark, url, n, whole[0], rows, **options) if whole else ["1 = 1"]
        spark.read.jdbc(url, n, predicates=ranges, properties=options).write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths
