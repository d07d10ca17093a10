"""Filter interaction audit: what each of several filters removes, in every order in which they could be applied.

1. Routing: an RDD of fingerprints. A task gives each text its xxhash, joins equal ones of its own rows to one entry, and sends
   entries on, partitioned by hash and sorted by it. The receiver holds the chain of one hash at a time: entries with whole text and
   smallest id, so texts that collide are told apart. Both sides emit the ids that aren't the smallest at once, without their texts;
   so a text that many rows share costs one entry a task, and no list of its ids is held.
2. Masks: a row's failed filters are the bits of a number. Failing depends on the text alone, but for copies, which depend on ids too.
   Rows are joined to labels by id after they were counted by id, part and mask, so no id makes a hot key.
3. Counts: ``combineByKey`` merges a vector of counts by mask for each part: rows, good rows and toxic ones. All orders follow from these.

Defined cases: null texts count as empty; null ids count as larger than all others, and rows of equal id and text aren't copies of each
other; a null part is the empty string; an id that is labelled twice is good, or toxic, if one label says so, null ids and null labels
are neither; an empty table gives an empty table; texts of any length are taken whole, and a task holds ``HELD`` bytes of distinct
texts, or one text; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import groupby, permutations
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Bytes of distinct texts that a task joins before it sends them on, and bytes of all texts for each partition of the routing.
HELD, PARTITION_BYTES = 1 << 25, 1 << 27


class Facts(NamedTuple):
    """What the filters ask of a text; words are runs of ``[^\\x20\\x09-\\x0D]``."""

    chars: int
    words: int
    distinct_words: int
    capitals: int
    symbols: int


_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: The filters by letter, each with when a text fails; None fails copies of the texts of smaller ids.
FILTERS: dict[str, Callable[[Facts], bool] | None] = {
    "A": lambda f: f.words < 100,
    "B": lambda f: 100 * f.distinct_words < 80 * f.words,
    "C": lambda f: 100 * f.capitals > 10 * f.chars,
    "D": lambda f: f.symbols > 0,
    "E": None,
}


def facts(text: str, data: bytes) -> Facts:
    words = data.split()
    return Facts(len(text), len(words), len(set(words)), len(data) - len(data.translate(None, _CAPITALS)), len(data) - len(data.translate(None, _SYMBOLS)))


def mask_of(text: str, data: bytes) -> int:
    f = facts(text, data)
    return sum(1 << bit for bit, fails in enumerate(FILTERS.values()) if fails and fails(f))


_COPY = sum(1 << bit for bit, fails in enumerate(FILTERS.values()) if fails is None)


class Entry:
    """A distinct text with its smallest id and the parts of the rows that have it."""

    __slots__ = ("data", "id", "mask", "parts")

    def __init__(self, data: bytes, id, mask: int, parts: dict[str, int]):
        self.data, self.id, self.mask, self.parts = data, id, mask, parts

    def join(self, id, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of the same text; yields those that have, or now have, a larger id."""
        if id == self.id:
            for part, n in parts.items():
                self.parts[part] = self.parts.get(part, 0) + n
            return
        if self.id is None or (id is not None and id < self.id):
            id, parts, self.id, self.parts = self.id, self.parts, id, dict(parts)
        for part, n in parts.items():
            yield id, part, self.mask | _COPY, n


def _sent(rows: Iterable[Row], held: int = HELD) -> Iterator[tuple]:
    """(fingerprint, entry) of the distinct texts of a task's rows, and (some hash, finished row) of what isn't smallest."""
    chains: dict[int, list[Entry]] = {}
    size = 0
    for id, part, text in rows:
        text, part = text or "", part or ""
        data = text.encode("utf-8", "surrogatepass")
        key = xxhash.xxh64_intdigest(data)
        chain = chains.setdefault(key, [])
        same = next((e for e in chain if e.data == data), None)
        if same is not None:
            for row in same.join(id, {part: 1}):
                yield xxhash.xxh64_intdigest(repr(row[0])), row
            continue
        chain.append(Entry(data, id, mask_of(text, data), {part: 1}))
        size += len(data)
        if size >= held:
            yield from _flushed(chains)
            size = 0
    yield from _flushed(chains)


def _flushed(chains: dict[int, list[Entry]]) -> Iterator[tuple]:
    for key, chain in chains.items():
        for e in chain:
            yield key, (e.id, e.parts, e.mask, e.data)
    chains.clear()


def _audited(routed: Iterable[tuple]) -> Iterator[tuple]:
    """(id, part, mask, rows) of all rows of a partition that is sorted by fingerprint."""
    for _, group in groupby(routed, key=lambda kv: kv[0]):
        chain: list[Entry] = []
        for _, (id, parts, mask, data) in ((k, v) for k, v in group):
            if not isinstance(parts, dict):  # finished: part, mask, number of rows
                yield id, parts, mask, data
                continue
            same = next((e for e in chain if e.data == data), None)
            if same is not None:
                yield from same.join(id, parts)
            else:
                chain.append(Entry(data, id, mask, parts))
        for e in chain:
            for part, n in e.parts.items():
                yield e.id, part, e.mask, n


def _home(key: int) -> int:
    return key


def masks(docs: DataFrame, id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(id, part, mask, n) of the rows, with n equal ones in a row at times."""
    rows = docs.select(F.col(id), F.col(part).cast("string"), F.col(text)).rdd.mapPartitions(_sent)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    routed: RDD = rows.repartitionAndSortWithinPartitions(parts, _home)
    fields = [T.StructField("id", docs.schema[id].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())]
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_audited), T.StructType(fields), verifySchema=False)


def _one(value: tuple, size: int) -> np.ndarray:
    return _more(np.zeros((3, size), dtype=np.int64), value)


def _more(counts: np.ndarray, value: tuple) -> np.ndarray:
    mask, n, good, toxic = value
    counts[:, mask] += (n, n * good, n * toxic)
    return counts


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def interactions(counts: np.ndarray, names: str) -> Iterator[tuple]:
    """Rows of all orders: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows, good, toxic = counts
    at = np.arange(rows.size)
    bit = {name: 1 << i for i, name in enumerate(names)}
    shapley = dict.fromkeys(names, 0)
    out = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            fails, late = (at & bit[name]) > 0, (at & before) > 0
            here = fails & ~late
            before |= bit[name]
            removed = int(rows[here].sum())
            shapley[name] += removed
            out.append(("".join(order), step, int(rows[(at & before) == 0].sum()), removed, int(rows[fails & late].sum()), int(rows[bit[name]]), int(good[here].sum()), int(toxic[here].sum()), name))
    for row in out:
        yield (*row[:-1], shapley[row[-1]])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _flags(labels: DataFrame, id: str, kind: T.DataType) -> DataFrame:
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return labels.where(F.col(id).isNotNull()).groupBy(F.col(id).cast(kind).alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step."""
    names = "".join(FILTERS)
    counted = masks(docs, id, part, text).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    known = counted.join(_flags(labels, id, docs.schema[id].dataType), "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    pairs = known.rdd.map(lambda r: (r[0], tuple(r[1:])))
    merged = pairs.combineByKey(partial(_one, size=1 << len(names)), _more, _added)
    return docs.sparkSession.createDataFrame(merged.flatMap(lambda kv: [(kv[0], *row) for row in interactions(kv[1], names)]), RESULT, verifySchema=False)


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH
texts AS (SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
    regexp_matches(t, '[#$%&*|]'), COALESCE(COALESCE(doc_id, 9223372036854775807) > min(doc_id) OVER (PARTITION BY t), false)] AS f FROM texts),
flags AS (SELECT doc_id, COALESCE(max(quality = 1), false) AS good, COALESCE(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, f, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM failed LEFT JOIN flags USING (doc_id) GROUP BY part, f),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a JOIN letters b ON b.i <> a.i JOIN letters c ON c.i NOT IN (a.i, b.i) JOIN letters d ON d.i NOT IN (a.i, b.i, c.i)
  JOIN letters e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
counted AS (
  SELECT part, o, step, o[step] AS i,
    sum(CASE WHEN NOT f[o[step]] AND NOT late THEN n ELSE 0 END) AS kept, sum(CASE WHEN f[o[step]] AND NOT late THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[o[step]] AND late THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f[o[step]] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN f[o[step]] AND NOT late THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN f[o[step]] AND NOT late THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS late FROM masks CROSS JOIN steps) GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM counted
"""
