"""Degraded variants of tables, with the truth about what was changed.

Rows are chosen by a seeded md5 hash of their key: exactly int(rows * share) of smallest hash, which a threshold in the
plan picks out, without a sort or join. Draws are repeatable and can be computed by other engines. Every degradation
returns (table, truth), where truth is a long table (issue, row, column); ``row`` is the key as text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import pick, seeded_hash
from ..functions.types import NUMERIC, ROW_INDEX, q, with_row_index

TRUTH = "issue string, row string, column string"
OUTLIER_FACTOR = 5
INVALID_NUMBER, INVALID_OTHER = "INVALID", "999999"


@dataclass(frozen=True)
class Scenario:
    missing: float = 0.0
    outliers: float = 0.0
    invalid: float = 0.0
    duplicates: float = 0.0
    formats: float = 0.0


#: Shares of the scenarios.
SCENARIOS = {
    "high_quality": Scenario(missing=0.03, outliers=0.01),
    "medium_quality": Scenario(missing=0.10, invalid=0.05, duplicates=0.05),
    "low_quality": Scenario(missing=0.20, outliers=0.05, invalid=0.10, formats=0.02),
}


#: The column that marks the chosen rows while a degradation is put together.
HIT = "_hit"


def chosen(df: DataFrame, keys: Sequence[str], share: float, seed: str, rows: int | None = None) -> DataFrame:
    """``df`` with a boolean ``HIT`` for exactly int(rows * share) rows; rows of one key are told apart by a hash of all their
    columns, and equal rows are interchangeable."""
    n = df.count() if rows is None else rows
    return pick(df, HIT, int(n * share), seeded_hash(seed, *[q(k) for k in keys]), seeded_hash(f"{seed}|row", *[q(c) for c in df.columns]))


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[q(k).cast("string") for k in keys])


def _truth(marked: DataFrame, keys: Sequence[str], issue: str, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    return marked.where(HIT).select(F.lit(issue).alias("issue"), key_text(keys).alias("row"), F.explode(names).alias("column"))


def _targets(df: DataFrame, keys: Sequence[str], kinds: tuple | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in keys and (kinds is None or isinstance(f.dataType, kinds))]


def missing(df: DataFrame, keys: Sequence[str], share: float, seed: str = "missing") -> tuple[DataFrame, DataFrame]:
    """All columns but the key of the chosen rows become null."""
    marked, names = chosen(df, keys, share, seed), _targets(df, keys)
    out = marked.select(*[F.when(~q(HIT), q(n)).alias(n) if n in names else q(n) for n in df.columns])
    return out, _truth(marked, keys, "missing", names)


def outliers(df: DataFrame, keys: Sequence[str], share: float, seed: str = "outliers") -> tuple[DataFrame, DataFrame]:
    """Numbers of the chosen rows are five times as large; integers end at the limits of their type."""
    names = _targets(df, keys, (T.LongType, T.DoubleType, T.IntegerType, T.FloatType))

    def larger(n: str) -> Column:
        kind = df.schema[n].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return (q(n) * OUTLIER_FACTOR).cast(kind)
        most = 2 ** (63 if isinstance(kind, T.LongType) else 31)
        wide = q(n).cast("decimal(20,0)") * OUTLIER_FACTOR
        return F.when(q(n).isNotNull(), F.least(F.greatest(wide, F.lit(-most).cast("decimal(20,0)")), F.lit(most - 1).cast("decimal(20,0)")).cast(kind))  # least and greatest skip nulls

    if not names:
        return df, df.sparkSession.createDataFrame([], TRUTH)
    marked = chosen(df, keys, share, seed)
    out = marked.select(*[F.when(q(HIT), larger(n)).otherwise(q(n)).alias(n) if n in names else q(n) for n in df.columns])
    return out, _truth(marked, keys, "outliers", names)


def invalid(df: DataFrame, keys: Sequence[str], share: float, seed: str = "invalid") -> tuple[DataFrame, DataFrame]:
    """Values of the chosen rows make no sense: numbers, whose columns become strings, read INVALID, others 999999."""
    marked, names = chosen(df, keys, share, seed), _targets(df, keys)

    def spoiled(n: str) -> Column:
        word = INVALID_NUMBER if isinstance(df.schema[n].dataType, NUMERIC) else INVALID_OTHER
        return F.when(q(HIT), F.lit(word)).otherwise(q(n).cast("string")).alias(n)

    out = marked.select(*[spoiled(n) if n in names else q(n) for n in df.columns])
    return out, _truth(marked, keys, "invalid", names)


def formats(df: DataFrame, keys: Sequence[str], share: float, seed: str = "format") -> tuple[DataFrame, DataFrame]:
    """Values of the chosen rows are written otherwise: a blank before or behind, comma for point, stars, capitals."""
    marked, names = chosen(df, keys, share, seed), _targets(df, keys)

    def rewritten(n: str) -> Column:
        v = q(n).cast("string")
        kind = seeded_hash(f"{seed}|{n}", *[q(k) for k in keys]) % 5
        new = F.when(kind == 0, F.concat(F.lit(" "), v)).when(kind == 1, F.concat(v, F.lit(" "))).when(kind == 2, F.replace(v, F.lit("."), F.lit(","))).when(kind == 3, F.concat(F.lit("*"), v, F.lit("*"))).otherwise(F.upper(v))
        return F.when(q(HIT), new).otherwise(v).alias(n)

    out = marked.select(*[rewritten(n) if n in names else q(n) for n in df.columns])
    return out, _truth(marked, keys, "format", names)


def duplicates(df: DataFrame, keys: Sequence[str], share: float, seed: str = "duplicates") -> tuple[DataFrame, DataFrame]:
    """The chosen rows once more, behind the others."""
    marked = chosen(df, keys, share, seed)
    return df.unionByName(marked.where(HIT).select(*[q(c) for c in df.columns])), _truth(marked, keys, "duplicates", [""])


def drawn_duplicates(df: DataFrame, share: float, seed: str = "duplicates") -> tuple[DataFrame, DataFrame]:
    """int(rows * share) rows drawn with replacement once more, behind the others, and a truth (row, source_row) of the
    indexes of the new rows and of those they repeat. Each draw is a seeded hash, met by the row index in one join."""
    indexed = with_row_index(df)
    n = indexed.count()
    draws = df.sparkSession.range(int(n * share)).select((F.lit(n) + F.col("id")).alias("row"), (seeded_hash(seed, F.col("id")) % max(n, 1)).cast("long").alias("source_row"))
    more = draws.join(indexed, F.col("source_row") == F.col(ROW_INDEX))
    return df.unionByName(more.select(*[q(c) for c in df.columns])), draws


_STEPS = (("missing", missing), ("outliers", outliers), ("invalid", invalid), ("formats", formats), ("duplicates", duplicates))


def scenario(df: DataFrame, keys: Sequence[str], plan: Scenario, seed: str = "scenario") -> tuple[DataFrame, DataFrame]:
    """All degradations of a scenario in fixed order, and their truth together."""
    truth = df.sparkSession.createDataFrame([], TRUTH)
    for name, step in _STEPS:
        if share := getattr(plan, name):
            df, part = step(df, keys, share, f"{seed}|{name}")
            truth = truth.unionByName(part)
    return df, truth


@dataclass(frozen=True)
class TruthRecord:
    """What is written beside a variant."""

    original_table: str
    quality_level: str
    generated_at: str
    row_count: int
    columns: list[str]
    original_schema: dict[str, str]
    expected_semantic_types: dict[str, str]
    quality_config: dict[str, float]
    degradation_metadata: dict = field(default_factory=dict)


def base_rows(spark: SparkSession, schema: dict[str, str], rows: int = 1000, seed: int = 42) -> DataFrame:
    """Rows of a schema of int, float, string, datetime and key: 1 to 1000, 10 to 1000, A to D, the last year, and 1 to ``rows``.

    Draws are hashes of seed, column and row, so that they are the same however the rows are partitioned.
    """

    def column(i: int, name: str, kind: str) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "id"), 12) / F.lit(2.0**52)
        match kind:
            case "key":
                value = F.col("id") + 1
            case "int":
                value = 1 + F.floor(u * 1000).cast("long")
            case "float":
                value = 10 + 990 * u
            case "string":
                value = F.element_at(F.array(*map(F.lit, "ABCD")), (1 + F.floor(u * 4)).cast("int"))
            case "datetime":
                value = F.date_sub(F.lit("2024-12-31").cast("date"), F.floor(u * 365).cast("int")).cast("timestamp_ntz")
            case _:
                value = F.lit(None).cast("string")
        return value.alias(name)

    return spark.range(rows).select(*[column(i, n, k) for i, (n, k) in enumerate(schema.items())])
