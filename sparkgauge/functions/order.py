"""Exact order statistics without a sort, and seeded choices of exactly k rows.

Both are radix selections: a level counts rows by the next bits of a key, for all columns and ranks at once, and follows the
bucket that holds each rank. No task ever ranks more rows than a level has buckets, however many rows there are.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: Low bits that each level of a selection leaves open; values that are few enough to be told apart at once.
_SHIFTS, FEW = (52, 39, 26, 13, 0), 1 << 16
_BITS, _LEVELS = 52, (40, 28, 16, 4, 0)
_SIGN = np.uint64(1 << 63)


def order_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; both zeros are one value."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def _value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _histogram(batches: Iterable[pa.RecordBatch], wanted: dict[int, list[int]] | None, above: int, shift: int) -> Iterator[pa.RecordBatch]:
    """(i, bucket, n) of a task's values: their keys without the low ``shift`` bits, of those whose keys without the low
    ``above`` bits are ``wanted`` in their column. Buckets are unsigned numbers in signed ones."""
    held: dict[int, dict[int, int]] = {}
    for batch in batches:
        for i, column in enumerate(batch.columns):
            if wanted is not None and i not in wanted:
                continue
            x = column.drop_null().to_numpy(zero_copy_only=False)
            keys = order_keys(x[~np.isnan(x)])
            if wanted is not None:
                keys = keys[np.isin(keys >> np.uint64(above), np.array(wanted[i], dtype=np.uint64))]
            buckets, counts = np.unique(keys >> np.uint64(shift), return_counts=True)
            own = held.setdefault(i, {})
            for b, n in zip(buckets.tolist(), counts.tolist(), strict=True):
                own[b] = own.get(b, 0) + n
    for i, own in held.items():
        buckets = np.fromiter(own, dtype=np.uint64, count=len(own)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i), pa.int32()), pa.array(buckets), pa.array(list(own.values()), pa.int64())], names=["i", "bucket", "n"])


def order_statistics(df: DataFrame, values: Sequence[Column], ranks: dict[int, Sequence[int]] | None = None, shares: Sequence[float] = ()) -> tuple[list[int], dict[int, dict[int, float]]]:
    """Counts of each expression's values, and its values of given ranks (from 0) in ascending order: ``ranks`` by expression,
    or the ranks on both sides of ``shares``. Nulls and NaN are left out; infinite values take part."""
    narrow = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def level(wanted: dict[int, list[int]] | None, above: int, shift: int) -> DataFrame:
        counted = narrow.mapInArrow(partial(_histogram, wanted=wanted, above=above, shift=shift), "i int, bucket long, n long")
        return stored(counted.groupBy("i", "bucket").agg(F.sum("n").alias("n")))

    first = level(None, 64, _SHIFTS[0])
    counts = [0] * len(values)
    for r in first.groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r.i] = r.n
    if ranks is None:
        ranks = {i: sorted({k for q in shares for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}) for i, n in enumerate(counts) if n}
    # (expression, rank) -> (bucket so far, rank within it)
    left = {(i, k): (0, k) for i, ks in ranks.items() for k in ks if k < counts[i]}
    out: dict[int, dict[int, float]] = {i: {} for i in range(len(values))}
    table, above, shift = first, 64, _SHIFTS[0]
    while left:
        todo = narrow.sparkSession.createDataFrame([(i, k, _signed(b), at) for (i, k), (b, at) in left.items()], "i int, k long, outer long, at long")
        # Rows of one outer bucket are as many as a level has buckets, or FEW.
        outer = F.shiftrightunsigned("bucket", above - shift) if above < 64 else F.lit(0).cast("long")
        running = table.withColumn("outer", outer).withColumn("upto", F.sum("n").over(Window.partitionBy("i", "outer").orderBy(F.col("bucket").bitwiseXOR(F.lit(-(2**63))))))
        hits = running.join(F.broadcast(todo), ["i", "outer"]).where("upto > at AND at >= upto - n").select("i", "k", "bucket", (F.col("at") - F.col("upto") + F.col("n")).alias("at"), "n")
        found = hits.collect()  # a row for each rank
        if shift == 0:
            for r in found:
                out[r.i][r.k] = _value(r.bucket % 2**64)
            break
        left = {(r.i, r.k): (r.bucket % 2**64, r.at) for r in found}
        rows = sum({(r.i, r.bucket): r.n for r in found}.values())
        wanted: dict[int, list[int]] = {}
        for (i, _), (b, _) in left.items():
            wanted.setdefault(i, []).append(b)
        above, shift = shift, 0 if rows <= FEW else _SHIFTS[_SHIFTS.index(shift) + 1]
        table = level(wanted, above, shift)
    return counts, out


def _signed(bucket: int) -> int:
    return bucket - 2**64 if bucket >= 2**63 else bucket


def quantiles(df: DataFrame, values: dict[str, Column], at: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each expression; nulls and NaN are left out, and columns without values give None.

    A quantile that lies on a value is that value, also beside infinite ones.
    """
    if not values:
        return {}
    counts, found = order_statistics(df, list(values.values()), shares=at)

    def between(i: int, share: float) -> float | None:
        if not counts[i]:
            return None
        h = (counts[i] - 1) * share
        lo, hi = found[i][math.floor(h)], found[i][math.ceil(h)]
        return lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))

    return {name: [between(i, share) for share in at] for i, name in enumerate(values)}


def seeded_hash(seed: str, *keys: Column) -> Column:
    """52 bits of md5 over the seed and the keys, which other engines can compute as well."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _threshold(hashes: DataFrame, k: int) -> tuple[int, int, int] | None:
    """Of the numbers ``h`` (52 bits), the ``k``-th smallest, how many of it are among the ``k`` smallest, and how many there
    are; None if there are fewer than ``k`` numbers."""
    left, path, n = k, 0, 0
    for depth, shift in enumerate(_LEVELS):
        here = hashes if depth == 0 else hashes.where(F.shiftright("h", _LEVELS[depth - 1]) == path)
        counts = sorted((r.b, r.n) for r in here.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n")).collect())  # 4096 rows at most
        for path, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None
    return path, left, n


def smallest(df: DataFrame, hashed: Column, k: int) -> Column:
    """A predicate that holds for the ``k`` rows of smallest hash: a comparison with a threshold found by radix counts.

    Rows that share the threshold's hash are taken together; ``pick`` takes exactly ``k``.
    """
    if k <= 0:
        return F.lit(False)
    found = _threshold(df.select(hashed.alias("h")), k)
    return F.lit(True) if found is None else hashed <= F.lit(found[0])


def pick(df: DataFrame, into: str, k: int, hashed: Column, *ties: Column) -> DataFrame:
    """``df`` with a boolean ``into`` that holds for exactly ``k`` rows (or all, if there are fewer): those of smallest hash.

    Rows that share the threshold's hash are told apart by the hashes ``ties``, in turn. Those alike in all of them, such as equal
    rows, are taken by their place in the input, which must give the same partitions when read again, as files and tables do.
    """
    if k <= 0:
        return df.withColumn(into, F.lit(False))
    hit, among, left = F.lit(False), F.lit(True), k
    for h in (hashed, *ties):
        found = _threshold(df.where(among).select(h.alias("h")), left)
        if found is None:
            return df.withColumn(into, hit | among)
        path, left, n = found
        hit, among = hit | (among & (h < F.lit(path))), among & (h == F.lit(path))
        if left == n:
            return df.withColumn(into, hit | among)
    place = f"{into}_place"
    df = df.withColumn(place, F.monotonically_increasing_id())
    partition = F.shiftright(place, 33)
    counts = {r.p: r.n for r in df.where(among).groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    for last in sorted(counts):
        if left <= counts[last]:
            break
        left -= counts[last]
    inner = F.col(place).bitwiseAND(F.lit(2**33 - 1))
    path, _, _ = _threshold(df.where(among & (partition == last)).select(inner.alias("h")), left)
    return df.withColumn(into, hit | (among & ((partition < last) | ((partition == last) & (inner <= path))))).drop(place)
