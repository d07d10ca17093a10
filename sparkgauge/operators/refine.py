"""Types of string columns from their values, and casts to given types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import columns_of, q

#: Words of booleans.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "t", "y"), ("false", "0", "no", "f", "n")
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no")
_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"
#: The rungs after boolean, in order: name, guard, Spark type.
RUNGS = (("bigint", _INTEGER, "bigint"), ("double", _NUMBER, "double"), ("date", _DATE, "date"), ("timestamp_ntz", _DATETIME, "timestamp_ntz"))


def _work(value: Column) -> Column:
    return F.when(value != "", value)


def as_boolean(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)


def guarded(value: Column, guard: str, kind: str) -> Column:
    """A text as ``kind`` where it is written as the guard has it, else null."""
    return F.when(value.rlike(guard), value).try_cast(kind)


def inferred(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, str]:
    """The type that each string column's values allow: the first of boolean, bigint, double, date and timestamp_ntz that
    takes every value besides null and "", else string.

    One aggregate with counts of valid values for all columns and types; distinct values for booleans are sketched by
    the smallest and largest, of which there are two at most if those are all.
    """
    names = columns_of(df, (T.StringType,)) if names is None else list(names)
    parts = []
    for i, n in enumerate(names):
        v = _work(q(n))
        parts += [F.count(v).alias(f"n{i}"), F.count_if(F.lower(v).isin(*BOOLEAN_WORDS)).alias(f"b{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
        parts += [F.count(guarded(v, guard, kind)).alias(f"r{i}_{k}") for k, (_, guard, kind) in enumerate(RUNGS)]
    if not parts:
        return {}
    row = df.agg(*parts).first()
    two = {i: n for i, n in enumerate(names) if row[f"n{i}"] and row[f"b{i}"] == row[f"n{i}"]}
    extra = df.agg(*[F.count_if(~q(n).isin(row[f"lo{i}"], row[f"hi{i}"]) & (q(n) != "")).alias(f"x{i}") for i, n in two.items()]).first() if two else None
    out = {}
    for i, n in enumerate(names):
        count = row[f"n{i}"]
        if not count:
            out[n] = "string"
        elif i in two and not extra[f"x{i}"]:
            out[n] = "boolean"
        else:
            out[n] = next((name for k, (name, _, _) in enumerate(RUNGS) if row[f"r{i}_{k}"] == count), "string")
    return out


def refined(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """String columns cast to their inferred types in one projection; "" becomes null where a type changes."""
    types = inferred(df) if types is None else types
    guards = {name: guard for name, guard, _ in RUNGS}

    def cast(n: str) -> Column:
        kind = types.get(n, "string")
        if kind == "string":
            return q(n)
        return (as_boolean(q(n)) if kind == "boolean" else guarded(q(n), guards[kind], kind)).alias(n)

    return df.select(*[cast(n) for n in df.columns])


#: Schema words of the generator and their types.
SCHEMA_TYPES = {"int": "bigint", "float": "double", "datetime": "timestamp_ntz", "string": "string"}


def schema_word(type_name: str) -> str:
    """A type's name in a catalog as a word of ``SCHEMA_TYPES``; intervals are strings."""
    low = type_name.lower()
    if "interval" in low:
        return "string"
    if "int" in low:
        return "int"
    if any(x in low for x in ("float", "double", "decimal", "real")):
        return "float"
    return "datetime" if any(x in low for x in ("timestamp", "date")) else "string"


def enforce(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns brought to the types of a schema of int, float, datetime and string; what doesn't convert becomes null.

    Of string columns, integers lose all characters but digits, point and minus, and floats all but digits, point, minus
    and comma, which must be a point to convert; numbers are cast as they are. Integers round half to even. Of strings,
    "nan", "None" and "NaT" become null.
    """

    def number(n: str, kept: str) -> Column:
        if isinstance(df.schema[n].dataType, T.StringType):
            return F.regexp_replace(q(n), kept, "").try_cast("double")
        return q(n).try_cast("double")

    def cast(n: str) -> Column:
        text = q(n).cast("string")
        match schema.get(n):
            case "int":
                if isinstance(df.schema[n].dataType, T.IntegralType):
                    return q(n).cast("bigint").alias(n)
                return F.bround(number(n, r"[^\d.-]")).try_cast("bigint").alias(n)
            case "float":
                return number(n, r"[^\d.,-]").alias(n)
            case "datetime":
                return text.try_cast("timestamp_ntz").alias(n)
            case "string":
                return F.when(~text.isin("nan", "None", "NaT"), text).alias(n)
        return q(n)

    return df.select(*[cast(n) for n in df.columns])


def cast_columns(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Explicit casts of the columns that are there; failures become null."""
    return df.select(*[q(n).try_cast(SCHEMA_TYPES[schema[n]]).alias(n) if schema.get(n) in SCHEMA_TYPES else q(n) for n in df.columns])


def null_words(df: DataFrame) -> DataFrame:
    """String columns with nan, none and nat, in any case, as null."""
    names = set(columns_of(df, (T.StringType,)))
    return df.select(*[F.when(~F.lower(q(n)).isin("nan", "none", "nat"), q(n)).alias(n) if n in names else q(n) for n in df.columns])
