"""Joins that Spark has no operator for: as-of joins and joins of overlapping intervals.

Both become equi-joins or windows over cells that the data's own distribution bounds, so that no key, instant or
range makes one task's work grow with the table. Columns of both sides travel in structs, so their names never clash.

Rows of hot cells are dealt by their place in the input, which must give the same partitions when read again, as files
and tables do.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import q
from ..sources.files import stored

#: Rows of both sides that a time bucket is meant to hold, and buckets at most.
BUCKET_ROWS, BUCKETS = 1 << 18, 8192
#: Rows of a key that one task joins at least, and keys that may be told to all tasks at most.
HOT_ROWS, HOT_KEYS = 1 << 12, 100_000
#: Ratio of the widths of two levels of bins.
STEP = 4


def whole(df: DataFrame) -> Column:
    return F.struct(*[q(c) for c in df.columns])


def _names(n: int) -> list[str]:
    return [f"_k{i}" for i in range(n)]


def _by(by: Sequence[str | tuple[str, str]]) -> tuple[list[str], list[str]]:
    pairs = [(b, b) if isinstance(b, str) else b for b in by]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _side(df: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """Keys and ``more`` under own names, a number that tells rows apart, and the row."""
    return df.select(*[q(c).alias(n) for n, c in zip(_names(len(keys)), keys, strict=True)], *[v.alias(n) for n, v in more.items()], F.monotonically_increasing_id().alias("_id"), whole(df).alias("_row"))


def _all_set(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


# as-of join


def _borders(times: DataFrame, rows: int, most: int) -> Column | None:
    """Time buckets of about ``rows`` rows, as a function of ``_t``: the number of borders at or before it."""
    n = times.count()
    buckets = min(most, math.ceil(n / rows))
    if buckets <= 1:
        return None
    shares = [i / buckets for i in range(1, buckets)]
    kind = times.schema["_t"].dataType.simpleString()
    found = times.agg(F.array_distinct(F.percentile_approx("_t", shares, max(10_000, 4 * buckets))).cast("array<string>").alias("b")).first().b
    borders = F.split(F.lit("\x1f".join(found)), "\x1f").cast(f"array<{kind}>")  # folded to one literal
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(found).bit_length()))])
    taken = lambda at, step: F.coalesce(F.get(borders, at + step - 1) <= F.col("_t"), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(taken(at, step), at + step).otherwise(at))


def asof_join(
    left: DataFrame, right: DataFrame, on: str | tuple[str, str], by: Sequence[str | tuple[str, str]] = (), direction: str = "backward", strict: bool = False,
    tolerance: Column | None = None, ties: Sequence[str] | None = None, how: str = "left", into: str = "matched", bucket_rows: int = BUCKET_ROWS, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left`` with, in the struct ``into``, the row of ``right`` of the same ``by`` columns that is nearest in ``on``:
    the last one at or before (``backward``) or the first at or after (``forward``) the left row's; ``strict`` leaves out
    equal values, and ``tolerance``, a number or an interval, rows that are further away.

    Rows of both sides meet in a union and a window carries the last right row on. The window's partitions are cells of
    a key and a time bucket; what was last in earlier buckets comes from a small table with a row for each cell. Buckets
    hold about ``bucket_rows`` rows by approximate quantiles; right rows of one key and time are first reduced to one,
    and left rows of a cell beyond ``hot_rows`` are dealt over copies of the cell's right rows. So neither a key nor an
    instant with a third of all rows makes a task's work grow with it.

    Of right rows equal in key and time the one greatest by ``ties`` counts, by default by all its columns that have
    an order. Null keys or times match nothing: such left rows have a null struct, or go with ``how='inner'``. NaN counts
    as greater than all numbers. Equal left rows stay as many as they are.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"Unknown direction: {direction}")
    if how not in ("left", "inner"):
        raise ValueError(f"Unknown kind of as-of join: {how}")
    lon, ron = (on, on) if isinstance(on, str) else on
    lby, rby = _by(by)
    keys = _names(len(lby))
    back = direction == "backward"
    ls, rs = _side(left, lby, _t=q(lon)), _side(right, rby, _t=q(ron))
    usable = _all_set([*keys, "_t"])
    ordered = [f.name for f in right.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))] if ties is None else ties
    best = F.max_by("_row", F.struct(*[F.col("_row")[c] for c in ordered])) if ordered else F.first("_row")
    rs = rs.where(usable).groupBy(*keys, "_t").agg(best.alias("_row"))
    ls_in = ls.where(usable)
    bucket = _borders(ls_in.select("_t").unionByName(rs.select("_t")), bucket_rows, BUCKETS)
    bucket = F.lit(0) if bucket is None else bucket
    ls_in, rs = ls_in.withColumn("_b", bucket), rs.withColumn("_b", bucket)
    cell = [*keys, "_b"]

    # A row for each cell that has left rows: over how many tasks they go, and the last right row of the buckets before.
    edge = F.max_by if back else F.min_by
    held = ls_in.groupBy(*cell).agg(F.count("*").alias("_n"))
    ends = rs.groupBy(*cell).agg(edge(F.struct("_t", "_row"), "_t").alias("_end"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b" if back else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    cells = held.join(ends, cell, "full").withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_n IS NOT NULL")
    cells = stored(cells.select(*cell, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"), "_n", "_carried"))
    least = max(hot_rows, (cells.agg(F.sum("_n")).first()[0] or 0) // HOT_KEYS)
    hot = F.broadcast(cells.where(F.col("_n") > least).select(*cell, "_parts"))  # HOT_KEYS rows at most

    def dealt(rows: DataFrame, copies: bool) -> DataFrame:
        parts = F.coalesce("_parts", F.lit(1))
        salt = F.explode(F.sequence(F.lit(0), parts - 1)) if copies else F.pmod(F.xxhash64("_id"), parts).cast("int")
        return rows.join(hot, cell, "left").withColumn("_salt", salt).drop("_parts", "_id")

    none = F.lit(None).cast(rs.schema["_row"].dataType)
    match = F.struct(F.col("_t").alias("t"), F.col("_row").alias("row"))
    mine = dealt(ls_in, False).select(*cell, "_salt", "_t", F.lit(True).alias("_left"), F.col("_row").alias("_l"), F.when(F.lit(False), F.struct(F.col("_t").alias("t"), none.alias("row"))).alias("_r"))
    empty = F.lit(None).cast(ls.schema["_row"].dataType)
    theirs = dealt(rs, True).select(*cell, "_salt", "_t", F.lit(False).alias("_left"), empty.alias("_l"), match.alias("_r"))
    carried = cells.where("_carried IS NOT NULL").select(*cell, "_carried._t", "_carried._row")
    carried = dealt(carried, True).select(*cell, "_salt", "_t", F.lit(False).alias("_left"), empty.alias("_l"), match.alias("_r"))
    side = F.col("_left") if not strict else ~F.col("_left")  # who comes first among equals
    order = Window.partitionBy(*cell, "_salt").orderBy(F.col("_t") if back else F.desc("_t"), side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = mine.unionByName(theirs).unionByName(carried).withColumn("_found", F.last("_r", ignorenulls=True).over(order)).where("_left")
    near = F.col("_found")
    if tolerance is not None:
        bound = F.col("_found.t") >= F.col("_t") - tolerance if back else F.col("_found.t") <= F.col("_t") + tolerance
        near = F.when(bound, near)
    found = found.select(F.col("_l").alias("_row"), near["row"].alias(into))
    if how == "inner":
        return found.where(F.col(into).isNotNull()).select("_row.*", into)
    return found.unionByName(ls.where(~usable).select("_row", none.alias(into))).select("_row.*", into)


# interval join


def _kind(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    return "number" if isinstance(kind, T.NumericType) else kind.simpleString()


def _line(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order: numbers as they are, dates and times in microseconds."""
    kind, c = df.schema[name].dataType, q(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000_000
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):  # by the clock, whatever the session's zone
        seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        return seconds.cast("double") * 1_000_000 + F.extract(F.lit("SECOND"), c).cast("double") * 1_000_000
    return c.cast("double")


def _dealt_join(a: DataFrame, b: DataFrame, keys: list[str], condition: Column, hot_rows: int) -> DataFrame:
    """``a`` joined to ``b`` on ``keys``; keys that are hot on either side are split into a grid of parts of both."""
    na, nb = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in ((a, "_na"), (b, "_nb")))
    counts = stored(na.join(nb, keys).where(F.greatest("_na", "_nb") > hot_rows))
    rows = counts.agg(F.sum(F.col("_na") + F.col("_nb"))).first()[0]
    if not rows:
        return a.drop("_id").join(b.drop("_id"), keys).where(condition)
    least = max(hot_rows, rows // HOT_KEYS)
    parts = lambda n: F.greatest(F.ceil(F.col(n) / least), F.lit(1)).cast("int")
    hot = F.broadcast(counts.where(F.greatest("_na", "_nb") > least).select(*keys, parts("_na").alias("_pa"), parts("_nb").alias("_pb")))  # HOT_KEYS rows at most

    def dealt(x: DataFrame, own: str, other: str) -> DataFrame:
        x = x.join(hot, keys, "left")
        x = x.withColumn(f"_s{own}", F.pmod(F.xxhash64("_id"), F.coalesce(f"_p{own}", F.lit(1))).cast("int"))
        return x.withColumn(f"_s{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_p{other}", F.lit(1)) - 1))).drop("_pa", "_pb", "_id")

    return dealt(a, "a", "b").join(dealt(b, "b", "a"), [*keys, "_sa", "_sb"]).where(condition)


def interval_join(
    left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], by: Sequence[str | tuple[str, str]] = (), into: tuple[str, str] = ("left", "right"), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of rows, as two structs, whose closed intervals overlap and whose ``by`` columns are equal; an instant is an
    interval with two equal ends, so range joins are interval joins.

    Intervals are covered by bins whose width follows their length: a level's bins are as wide as its longest interval,
    so an interval lies in two of them at most, and the next level's are ``STEP`` times as wide. A pair meets at the
    level of its longer interval, in the first bin that both have. So an interval is compared with those near it
    in terms of the longer of the two, and neither one long interval nor a few widen the bins of all. The narrowest width
    comes from a sketch of the lengths and from the density of the rows. Bins that hold many rows of a side are
    split into a grid of tasks.

    Null and NaN ends, null keys, and intervals that end before they start match nothing; infinite ends reach all.
    """
    kinds = {_kind(df, c) for df, on in ((left, left_on), (right, right_on)) for c in on}
    if len(kinds) > 1:
        raise ValueError(f"Ends of intervals must be of one kind: {sorted(kinds)}")
    lby, rby = _by(by)
    keys = _names(len(lby))

    def side(df: DataFrame, names: Sequence[str], on: tuple[str, str]) -> DataFrame:
        start, end = (_line(df, c) for c in on)
        return _side(df, names, _start=start, _end=end).where(_all_set([*keys, "_start", "_end"]) & ~F.isnan("_start") & ~F.isnan("_end") & (F.col("_row")[on[0]] <= F.col("_row")[on[1]]))

    ls, rs = side(left, lby, left_on), side(right, rby, right_on)
    ends = ls.select("_start", "_end").unionByName(rs.select("_start", "_end"))
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    facts = ends.agg(F.count("*").alias("n"), F.min(F.least(finite("_start"), finite("_end"))).alias("lo"), F.max(F.greatest(finite("_start"), finite("_end"))).alias("hi"), F.percentile_approx(finite("_end") - finite("_start"), 0.25, 1000).alias("short")).first()
    lo, hi = facts.lo or 0.0, facts.hi or 0.0
    span = hi - lo
    if not math.isfinite(span):  # ends near the limits of doubles: one bin
        lo, hi, span = 0.0, 0.0, 0.0
    width = max(facts.short or 0.0, span / max(facts.n, 1)) or 1.0
    clipped = lambda c: F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) - F.lit(lo)

    def levelled(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_from": clipped("_start"), "_to": clipped("_end")})
        longer = (F.col("_to") - F.col("_from")) / F.lit(width)
        return df.withColumn("_level", F.when(longer <= 1, 0).otherwise(F.ceil(F.log(float(STEP), longer))).cast("int"))

    ls, rs = levelled(ls), levelled(rs)
    homes = [sorted(r[0] for r in x.select("_level").distinct().collect()) for x in (ls, rs)]  # a few levels: their number follows the logarithm of the span

    def bins(df: DataFrame, levels: Sequence[int], name: str, above: int | None) -> DataFrame:
        """Rows once for each bin they lie in: of their own level, or of those of ``levels`` that are ``above`` or more over it."""
        own = F.col("_level")
        at = F.array(own) if above is None else F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= own + above)
        df = df.select(*keys, "_id", "_from", "_to", F.explode(at).alias("_m"), F.col("_row").alias(name))
        wide = F.lit(width) * F.pow(F.lit(float(STEP)), F.col("_m"))
        first, last = F.floor(F.col("_from") / wide), F.floor(F.col("_to") / wide)
        return df.select(*keys, "_id", "_m", first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("_bin"), name)

    l0, l1, r0, r1 = (F.col("_l")[left_on[0]], F.col("_l")[left_on[1]], F.col("_r")[right_on[0]], F.col("_r")[right_on[1]])
    once = (F.col("_bin") == F.greatest("_l_first", "_r_first")) & (l0 <= r1) & (r0 <= l1)
    on = [*keys, "_m", "_bin"]
    out = [F.col("_l").alias(into[0]), F.col("_r").alias(into[1])]
    mine = _dealt_join(bins(ls, (), "_l", None), bins(rs, homes[0], "_r", 0), on, once, hot_rows).select(*out)
    theirs = _dealt_join(bins(ls, homes[1], "_l", 1), bins(rs, (), "_r", None), on, once, hot_rows).select(*out)
    return mine.unionByName(theirs)
