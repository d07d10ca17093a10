"""MinHash near-dedup with b-bit signatures.

1. A pass over the texts makes, for each document, its set of word shingles, 128 minima, the 32 hashes of their bands of
   four, and a signature of the low two bits of each minimum, packed into four longs. Documents with equal sets form one
   class, and from here on only classes count.
2. Band candidates: classes that share a band meet in a bucket. The centre of a bucket is the member that stands in the
   fullest buckets, as the text that others are copies of does. Every member is held against its centres: by size, by the
   similarity estimated from bit counts and corrected for chance collisions of low bits, then on full sets, which are
   made again from the texts of these candidates alone.
3. What the centres link is joined to components. In buckets that still hold several, other pairs of members count:
   those of small buckets by estimate and full sets, as before; those of large ones around a common centre as in 4.
4. Around a centre B a set is what it lacks of B and what it has beside B, its difference. Two sets share
   |B| - r - r' elements of B, where r and r' are what they lack, and as many more as their differences share; so the similarity
   follows exactly from the elements that differences share. If neither is linked with B, or one is, a link asks for a
   number of shared elements above 0, mostly about half of the difference, and pairs are found by the rarest elements of
   differences (a prefix filter) and then counted. Those linked with B are in one component already. So a family of
   near copies costs its differences, not its pairs. Outliers and members are dealt into blocks bounded in sets and in
   elements, and a task holds one of each.
5. Components of all links.

A link of similarity 0.8 is missed by all bands with probability (1 - 0.8**4)**32 < 1e-7, by the estimate < 1e-5.

Buckets are aggregated before they are joined, and joins on a hot centre or hub are dealt over several tasks. Bitmaps of
bounded size keep documents that nothing happens to out of shuffles; beyond some tens of millions of candidates they fill
up, and all texts pass one shuffle a pass.

Defined cases: null and empty texts have no shingles, link with nothing and stay; fewer words than a shingle are one
shingle; null doc_ids come last in a group (the id 2**63 - 1 counts as null); equal rows belong to one group; an empty
table gives an empty result; texts of any length are taken whole, a task holds one block of sets; other columns, whatever
their names, pass through ``keep`` in a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, maybe, released, spread, table, whole, written
from .components import components
from .hashing import hashed_texts, mixed, shingles

HASHES, ROWS, BITS = 128, 4, 2
THRESHOLD = 80
#: Pairs estimated below this share go unconfirmed: 0.8 less about five standard errors.
LEAST_ESTIMATE = 0.6
#: Members of a bucket up to which its pairs are held against each other in a join.
SMALL = 32
#: Sets, and elements of their differences, of a block.
BLOCK_SETS, BLOCK_ITEMS = 4096, 1 << 20
_LAST = 2**63 - 1
_RANDOM = np.random.Generator(np.random.PCG64(90_417))
_A = _RANDOM.integers(1, 2**64 - 1, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RANDOM.integers(1, 2**64 - 1, HASHES, dtype=np.uint64)
_BAND = mixed(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64))
_STEP = 1024


def minima(values: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(values), _STEP):
        v = values[at : at + _STEP]
        np.minimum(out, ((_A[:, None] * v + _B[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    out = _BAND.copy()
    for column in m.reshape(-1, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    low = (m & np.uint64(3)).reshape(4, 32)
    return np.bitwise_or.reduce(low << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, n = batch.column("text"), batch.num_rows
        if not n:
            continue
        sizes, ids, bands, packs = np.zeros(n, dtype=np.int64), [None] * n, np.zeros((n, HASHES // ROWS), dtype=np.uint64), np.zeros((n, 4), dtype=np.uint64)
        for i, words in enumerate(hashed_texts(texts)):
            values = np.unique(shingles(words, k))
            if len(values):
                m = minima(values)
                sizes[i], ids[i], bands[i], packs[i] = len(values), hashlib.md5(values.tobytes()).digest(), band_keys(m), packed(m)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (HASHES // ROWS))
        columns = [batch.column("k"), batch.column("kt"), pa.array(sizes), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()))]
        yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(packs[:, j]).view(np.int64)) for j in range(4)], ["k", "kt", "n", "cid", "bands", "s0", "s1", "s2", "s3"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sets of wanted classes."""
    last: tuple = ()
    for batch in batches:
        wanted, keys = batch.column("cid").to_pylist(), batch.column("k").to_pylist()
        ids, sets, held = [], [], 0
        for key, cid, words in zip(keys, wanted, hashed_texts(batch.column("text")), strict=True):
            values = np.unique(shingles(words, k))
            if (key, cid) == last or hashlib.md5(values.tobytes()).digest() != cid:  # rows of one key come together
                continue
            last = (key, cid)
            ids.append(cid)
            sets.append(values.view(np.int64))
            held += len(values)
            if held > 1 << 20:
                yield _batch(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield _batch(ids, sets)


def _batch(ids: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["cid", "items"])


class Block:
    """Outliers of one centre, indexed by the rarest elements of their differences."""

    def __init__(self, centre: int, percent: int):
        self.allowed, self.percent = (100 - percent) * centre, percent
        self.ids: list[bytes] = []
        self.comps: list[bytes] = []
        self.differences: list[np.ndarray] = []
        self.costs: list[int] = []
        self.root: dict[bytes, bytes] = {}
        self.index: dict[int, list[int]] | None = None

    def add(self, cid: bytes, comp: bytes, difference: np.ndarray, cost: int) -> None:
        self.ids.append(cid)
        self.comps.append(comp)
        self.differences.append(difference)
        self.costs.append(cost)

    def _find(self, comp: bytes) -> bytes:
        while (up := self.root.get(comp, comp)) != comp:
            self.root[comp] = self.root.get(up, up)
            comp = up
        return comp

    def _prepare(self) -> None:
        """Elements by rising frequency; of each outlier those are indexed of which a link shares one at least."""
        self.elements, place, counts = np.unique(np.concatenate(self.differences), return_inverse=True, return_counts=True)
        order = np.empty(len(counts), dtype=np.int64)
        order[np.lexsort((self.elements, counts))] = np.arange(len(counts))
        self.order = order
        self.index, at = {}, 0
        for i, (d, cost) in enumerate(zip(self.differences, self.costs, strict=True)):
            own = np.sort(order[place[at : at + len(d)]])
            at += len(d)
            least = max(1, -(-(cost - self.allowed + 1) // (100 + self.percent)))
            for e in own[: len(d) - least + 1].tolist():
                self.index.setdefault(e, []).append(i)

    def links(self, cid: bytes, comp: bytes, difference: np.ndarray, cost: int) -> list[tuple[bytes, bytes]]:
        """New links between a member and the outliers: a forest over components, counted exactly."""
        if self.index is None:
            self._prepare()
        prefix = len(difference) - cost // (100 + self.percent)
        at = np.searchsorted(self.elements, difference)
        at[at == len(self.elements)] = 0
        known = self.elements[at] == difference
        prefix -= len(difference) - int(known.sum())  # elements that no outlier has are the rarest
        if prefix <= 0:
            return []
        own = np.sort(self.order[at[known]])[:prefix]
        near = set().union(*[self.index.get(e, ()) for e in own.tolist()])
        out, home = [], self._find(comp)
        for i in sorted(near):
            other = self._find(self.comps[i])
            if other == home or self.ids[i] == cid:
                continue
            shared = np.intersect1d(self.differences[i], difference, assume_unique=True).size
            if (100 + self.percent) * shared >= cost + self.costs[i] - self.allowed:
                out.append((cid, self.ids[i]))
                self.root[other] = home
        return out


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(v, x, comp, n, cost, outlier, items): the difference of each set to its centre, and what it costs."""
    for batch in batches:
        a, b = batch.column("items"), batch.column("centre")
        xs, vs = a.values.to_numpy(), b.values.to_numpy()
        ao, bo = a.offsets.to_numpy(), b.offsets.to_numpy()
        items, sizes, costs = [], [], []
        for i in range(batch.num_rows):
            x, v = xs[ao[i] : ao[i + 1]], vs[bo[i] : bo[i + 1]]
            both = np.setxor1d(x, v, assume_unique=True)
            lacks = (len(v) + len(both) - len(x)) // 2
            items.append(both)
            sizes.append(len(v))
            costs.append(100 * lacks + percent * (len(both) - lacks))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
        far = [c > (100 - percent) * n for c, n in zip(costs, sizes, strict=True)]
        columns = [batch.column("v"), batch.column("u"), batch.column("comp"), pa.array(sizes, pa.int64()), pa.array(costs, pa.int64()), pa.array(far, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items) if items else [], pa.int64()))], ["v", "u", "comp", "n", "cost", "outlier", "items"])


DIFFERENCES = "v binary, u binary, comp binary, n long, cost long, outlier boolean, items array<long>"


def _around(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks (v, i, j): outliers come first, then members stream by."""
    key, block = None, None
    for batch in batches:
        found: list[tuple[bytes, bytes]] = []
        items = batch.column("items")
        values, offsets = items.values.to_numpy(), items.offsets.to_numpy()
        keys = list(zip(batch.column("v").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
        ids, comps, roles = batch.column("u").to_pylist(), batch.column("comp").to_pylist(), batch.column("role").to_pylist()
        sizes, costs = batch.column("n").to_pylist(), batch.column("cost").to_pylist()
        for r, k in enumerate(keys):
            if k != key:
                key, block = k, Block(sizes[r], percent)
            difference = values[offsets[r] : offsets[r + 1]]
            if roles[r] == 0:
                block.add(ids[r], comps[r], difference.copy(), costs[r])
            elif block.ids:
                found += block.links(ids[r], comps[r], difference, costs[r])
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["u", "v"])


def _agree(a: str, b: str) -> Column:
    """Slots of low bits that agree, by bit counts."""
    total = F.lit(0)
    for j in range(4):
        x = F.col(f"{a}.s{j}").bitwiseXOR(F.col(f"{b}.s{j}"))
        differ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + (32 - F.bit_count(differ))
    return total


def _estimated(a: str, b: str, share: float) -> Column:
    """Whether the similarity, estimated with a correction for collisions of low bits, is ``share`` or more."""
    chance = 1 / 2**BITS
    return _agree(a, b) >= HASHES * (chance + (1 - chance) * share)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64("text").alias("kt"), "text")


def _alike(percent: int) -> Column:
    """Whether the classes a and b may be linked, by their sizes and estimate."""
    least = percent / 100 - (THRESHOLD / 100 - LEAST_ESTIMATE)
    return (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & _estimated("a", "b", least)


def _centred(classes: DataFrame) -> DataFrame:
    """(key, cid, size, centre) of the members of all buckets of two classes or more."""
    members = classes.select("cid", F.explode("bands").alias("key"))
    buckets = written(members.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("low")).where("size > 1"))
    members = written(spread(members, buckets, "key", F.xxhash64("cid"), counts=buckets.select("key", F.col("size").alias("_rows"))))
    # the centre of a larger bucket is the member of the fullest buckets
    full = members.where("size > 2").groupBy("cid").agg(F.sum("size").alias("weight"))
    weighed = members.where("size > 2").join(full, "cid")
    centres = written(weighed.groupBy("key").agg(F.max(F.struct("weight", "cid")).alias("best")).select("key", F.col("best.cid").alias("centre")))
    pairs = members.where("size = 2").select("key", "cid", "size", F.col("low").alias("centre"))
    out = written(pairs.unionByName(spread(members.where("size > 2").drop("low"), centres, "key", F.xxhash64("cid"), counts=buckets.select("key", F.col("size").alias("_rows"))).select("key", "cid", "size", "centre")))
    released(members, centres, buckets)
    return out


def _sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, items) of the classes named in ``wanted`` (cid), made again from one text each."""
    need = written(classes.select("cid", "k").join(wanted.distinct(), "cid", "left_semi").withColumn("h", F.xxhash64("k")))
    texts = maybe(_keyed(docs).select("k", "text", F.xxhash64("k").alias("h")), "h", bitmap(need, "h")).where("maybe").select("k", "text")
    sets = written(texts.join(need.drop("h"), "k").mapInArrow(partial(_sets, k=k), "cid binary, items array<long>"))
    released(need)
    return sets


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The written pairs (u, v) whose full sets are similar enough; ``v`` may be hot."""
    centred = spread(pairs, sets.select(F.col("cid").alias("v"), F.col("items").alias("b")), "v", F.xxhash64("u"))
    both = centred.join(sets.select(F.col("cid").alias("u"), F.col("items").alias("a")), "u")
    common = F.size(F.array_intersect("a", "b"))
    near = 100 * common >= percent * (F.size("a") + F.size("b") - common)
    return written(both.where(near).select("u", "v"))


def _outlying(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) around the centres of large buckets, where some member is linked with no centre. ``open_`` has v, u, comp."""
    held = spread(open_, sets.select(F.col("cid").alias("v"), F.col("items").alias("centre")), "v", F.xxhash64("u"))
    held = held.join(sets.select(F.col("cid").alias("u"), "items"), "u")
    away = written(held.select("v", "u", "comp", "items", "centre").mapInArrow(partial(_differences, percent=percent), DIFFERENCES))
    size, far = F.size("items"), F.col("outlier")
    dealt = away.groupBy("v").agg(F.count("*").alias("sets"), F.sum(size).alias("items"), F.count_if(far).alias("far_sets"), F.sum(F.when(far, size)).alias("far_items")).where("far_sets > 0")
    block = F.greatest(F.lit(BLOCK_SETS // 16), F.least(F.lit(BLOCK_SETS), F.col("sets") / 8))  # small families are dealt finer
    n = lambda sets, items: F.greatest(F.ceil(F.col(sets) / block), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("int")
    dealt = written(dealt.select("v", n("far_sets", "far_items").alias("outer"), n("sets", "items").alias("inner")))
    rows = spread(away, dealt, "v", F.xxhash64("u")).withColumn("h", F.xxhash64("u"))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["v", "u", "comp", "n", "cost", "items"]
    outer = rows.where("outlier").select(*columns, own("outer").alias("i"), every("inner").alias("j"), F.lit(0).alias("role"))
    inner = rows.select(*columns, every("outer").alias("i"), own("inner").alias("j"), F.lit(1).alias("role"))
    groups = outer.unionByName(inner).repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "role", "u")
    out = written(groups.mapInArrow(partial(_around, percent=percent), "u binary, v binary"))
    released(away)
    return out


def _links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) of the classes of every component of links but its root."""
    bits = classes.select("cid", "n", "s0", "s1", "s2", "s3")
    members = _centred(classes)
    stars = members.where("cid != centre").select(F.col("cid").alias("u"), F.col("centre").alias("v")).distinct()
    stars = spread(written(stars), bits.select(F.col("cid").alias("v"), F.struct("n", "s0", "s1", "s2", "s3").alias("b")), "v", F.xxhash64("u"))
    stars = stars.join(bits.select(F.col("cid").alias("u"), F.struct("n", "s0", "s1", "s2", "s3").alias("a")), "u")
    stars = written(stars.where(_alike(percent)).select("u", "v"))
    sets = _sets_of(docs, classes, stars.select(F.col("u").alias("cid")).unionByName(stars.select(F.col("v").alias("cid"))), k)
    first = components(_confirmed(stars, sets, percent))
    released(sets, stars)

    # buckets of which members beside the centre are in several components
    comps = first.select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    rest = written(members.where("size > 2 AND cid != centre").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    still = written(rest.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select("key"))
    rest = spread(rest, still, "key", F.xxhash64("cid"))
    rest = written(rest.select("key", "cid", "size", "centre", "comp"))
    little = rest.where(F.col("size") <= SMALL).select("key", "cid", "comp").join(bits, "cid")
    side = lambda name: little.select("key", F.struct("cid", "comp", "n", "s0", "s1", "s2", "s3").alias(name))
    pairs = side("a").join(side("b"), "key").where((F.col("a.cid") > F.col("b.cid")) & (F.col("a.comp") != F.col("b.comp")) & _alike(percent))
    pairs = written(pairs.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).distinct())
    large = written(rest.where(F.col("size") > SMALL).select(F.col("centre").alias("v"), F.col("cid").alias("u"), "comp").distinct())
    wanted = pairs.unionByName(large.select("u", "v"))
    if wanted.isEmpty():
        return first
    sets = _sets_of(docs, classes, wanted.select(F.col("u").alias("cid")).unionByName(wanted.select(F.col("v").alias("cid"))), k)
    more = _confirmed(pairs, sets, percent)
    if not large.isEmpty():
        more = more.unionByName(_outlying(large, sets, percent))
    # links between components join these
    for end, other in (("u", "v"), ("v", "u")):
        more = written(spread(written(more), first.select(F.col("node").alias(end), "root"), end, F.xxhash64(other), "left").select(F.coalesce("root", end).alias(end), other))
    joined = components(more)
    released(sets, rest, members)
    top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    out = spread(first, top, "root", F.xxhash64("node"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(out.unionByName(joined))


def grouped(docs: DataFrame, k: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): k, kt (keys of the row), n (size of its set), gid (id of its group), root (smallest k of its group)."""
    rows = written(_keyed(docs).mapInArrow(partial(_signatures, k=k), "k long, kt long, n long, cid binary, bands array<long>, s0 long, s1 long, s2 long, s3 long"))
    sig = F.struct("n", "bands", "s0", "s1", "s2", "s3")
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("k").alias("k"), F.first(sig).alias("s")).select("cid", "k", "s.*")
    classes = written(classes)
    comps = _links(docs, classes, k, percent)

    full = comps.unionByName(comps.select(F.col("root").alias("node"), "root").distinct())
    full = written(full.join(classes.select(F.col("cid").alias("node"), "k"), "node"))
    lowest = full.groupBy("root").agg(F.min("k").alias("low"))
    named = spread(full, lowest, "root", F.xxhash64("node")).select(F.col("node").alias("cid"), F.col("root").alias("gid"), "low")
    named = written(classes.select("cid", "k").join(named, "cid", "left").select("cid", F.coalesce("gid", "cid").alias("gid"), F.coalesce("low", "k").alias("low")))
    plain = rows.select("k", "kt", "n", "cid").where("cid IS NULL").select("k", "kt", "n", F.lit(None).cast("binary").alias("gid"), F.col("k").alias("root"))
    told = spread(rows.select("k", "kt", "n", "cid").where("cid IS NOT NULL"), named, "cid", F.xxhash64("k"))
    return plain.unionByName(told.select("k", "kt", "n", "gid", F.col("low").alias("root")))


def keep(docs: DataFrame, k: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest doc_id; columns as in the input."""
    found = written(grouped(docs, k, percent))
    stay = found.where("k = root")
    # of rows that share the doc_id which stays, that with the smallest hash of its text; texts without words all stay
    alike = stay.where("gid IS NOT NULL").groupBy("gid", "k").agg(F.min("kt").alias("kt")).select("k", "kt", F.lit(True).alias("words"))
    stay = alike.unionByName(stay.where("gid IS NULL").select("k", "kt", F.lit(False).alias("words"))).distinct()
    found = written(found.groupBy("k", "kt").agg(F.count("*").alias("rows")).join(stay, ["k", "kt"], "left"))
    # only documents that go, or of which there are several rows, are shuffled
    touched = written(found.where("words IS NULL OR (words AND rows > 1)"))
    rows = docs.select(whole(docs).alias("d")).withColumn("k", F.coalesce(F.col("d.doc_id").cast("long"), F.lit(_LAST))).withColumn("kt", F.xxhash64("d.text"))
    rows = maybe(rows, "kt", bitmap(touched, "kt"))
    checked = rows.where("maybe").join(touched.select("k", "kt", F.coalesce("words", F.lit(False)).alias("again"), F.lit(True).alias("hit")), ["k", "kt"], "left")
    several = checked.where("again").dropDuplicates(["k", "kt"])
    return rows.where("NOT maybe").select("d.*").unionByName(checked.where("hit IS NULL").select("d.*")).unionByName(several.select("d.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = grouped(docs, k=2)
    doc_id, root = F.nullif(F.col("k"), F.lit(_LAST)), F.nullif(F.col("root"), F.lit(_LAST))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


#: Groups of ``docs(doc_id, text)`` of unique ids by all pairs of two-word sets; for tables that such pairs are cheap on.
SQL = r"""
n_words AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs),
n_sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) END AS s FROM n_words),
n_classes AS MATERIALIZED (SELECT s, min(doc_id) AS c, len(s) AS n FROM n_sets WHERE len(s) > 0 GROUP BY s),
n_terms AS MATERIALIZED (SELECT c, n, unnest(s) AS t FROM n_classes),
n_links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM n_terms a JOIN n_terms b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
n_edges AS (SELECT a, b FROM n_links UNION ALL SELECT b, a FROM n_links),
n_reach(a, b) AS (SELECT c, c FROM n_classes UNION SELECT r.a, e.b FROM n_reach r JOIN n_edges e ON e.a = r.b),
n_low AS (SELECT a AS c, min(b) AS low FROM n_reach GROUP BY a),
n_grouped AS (SELECT doc_id, len(n_sets.s)::BIGINT AS n_shingles, COALESCE(low, doc_id) AS component_id FROM n_sets LEFT JOIN n_classes ON n_classes.s = n_sets.s LEFT JOIN n_low USING (c))
"""
OP7_SQL = "WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), " + SQL + """
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n_grouped
"""
