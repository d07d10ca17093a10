"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every training passage.

Terms are pairs of adjacent words (runs of letters and digits, lower-cased), whose postings are short, so that clean
passages touch few of them. An item's scores are divided by the score it gives itself; a passage retrieves all items with
a share of ``SHARE`` or more. Passages are windows of twice the longest item, one item length apart, so that every item
lies whole in some passage; texts are worked through whole. A retrieved item counts as leaked if at least ``OVERLAP`` of
the five-word shingles of its question part (its first two thirds) and of its answer part (the rest) are in the text.

Items have one text without marks of where an answer begins; that an item's last third must be found as well keeps passages
that share no more than its opening from counting.

The index holds the test items alone. Those are counted before: beyond ``SHARD_BYTES`` they are dealt over several
indexes by hash, and the corpus is read once for each; frequencies and the mean length are counted once over all items, so
shards don't change a score. Documents stream through ``mapInArrow`` without a shuffle.

Defined cases: null and empty texts retrieve nothing and stay; null items and those without words are left out; items of
two to four words leak where they stand verbatim, and one of a single word where it is a whole text; items of equal
text are found together; repeated rows give repeated results; empty tables give empty results; texts of any length are
taken whole; other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, whole, written
from .hashing import ALNUM, hashed_texts, shingles

SHARE = 0.5
OVERLAP = 0.4
K1, B = 1.2, 0.75
BLOCK = 16
MIN_WORDS = 5
MIN_SPAN = 64
SHARD_BYTES = 16 << 20
RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


class Index:
    """Postings of the items' word pairs with normalised impacts, and what confirms an item."""

    def __init__(self, items: list[tuple[int, str]], counted: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        """``counted``: number and mean length of all items, sorted terms (those of these items at least) and in how many of
        all items each is; by default of these items alone."""
        texts = [words for words in hashed_texts(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)]
        use = [i for i, w in enumerate(texts) if len(w) >= MIN_WORDS]
        few = [i for i, w in enumerate(texts) if 0 < len(w) < MIN_WORDS]
        self.ids = [items[i][0] for i in [*use, *few]]
        self.short: dict[int, dict[int, list[int]]] = {}
        for n, i in enumerate(few, len(use)):
            k = len(texts[i])
            self.short.setdefault(k, {}).setdefault(int(shingles(texts[i], k)[0]), []).append(n)
        words = [texts[i] for i in use]
        self.span = max([MIN_SPAN, *map(len, words)])
        pairs = [np.unique(shingles(w, 2), return_counts=True) for w in words]
        self.terms, df = np.unique(np.concatenate([t for t, _ in pairs]) if pairs else np.empty(0, dtype=np.uint64), return_counts=True)
        n, mean = len(words), sum(map(len, words)) / max(1, len(words))
        if counted is not None:
            n, mean, terms, all_df = counted
            df = all_df[np.searchsorted(terms, self.terms)]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, (terms, tf) in enumerate(pairs):
            at = np.searchsorted(self.terms, terms)
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / mean))
            for t, x in zip(at.tolist(), (impact / impact.sum()).tolist(), strict=True):
                postings[t].append((i, x))
        self.items = [[i for i, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.block_most = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.impacts], dtype=float)
        cut = [max(MIN_WORDS, len(w) - max(MIN_WORDS, len(w) // 3)) for w in words]
        self.question = [np.unique(shingles(w[:c], 5)) for w, c in zip(words, cut, strict=True)]
        self.answer = [np.unique(shingles(w[-max(MIN_WORDS, len(w) // 3) :], 5)) for w in words]

    def search(self, terms: list[int], least: float = SHARE) -> list[tuple[int, float]]:
        """All items whose share for a query of distinct ``terms`` is at least ``least``: block-max WAND."""
        least -= 1e-9
        most, lists = self.most, [[self.items[t][0], 0, t] for t in terms]
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            if lists[0][0] == item:
                block, end = 0.0, math.inf
                for _, at, t in lists[: pivot + 1]:
                    block += self.block_most[t][at // BLOCK]
                    end = min(end, self.items[t][min((at // BLOCK + 1) * BLOCK, len(self.items[t])) - 1])
                if block >= least:
                    score = sum(self.impacts[t][at] for _, at, t in lists[: pivot + 1])
                    if score >= least:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = min(end + 1, lists[pivot + 1][0] if pivot + 1 < len(lists) else math.inf)
                    to = max(to, item + 1)
                moved = lists[: pivot + 1]
            else:
                to, moved = item, [x for x in lists[:pivot] if x[0] < item]
            for x in moved:
                own = self.items[x[2]]
                x[1] = bisect_left(own, to, x[1])
                x[0] = own[x[1]] if x[1] < len(own) else math.inf
            lists = [x for x in lists if x[0] != math.inf]
        return found

    def leaks(self, words: np.ndarray) -> list[tuple[int, float, float, float]]:
        """(item, best share, overlap of question, of answer) of the items that a text of these words leaks."""
        return self._verbatim(words) + self._searched(words)

    def _verbatim(self, words: np.ndarray) -> list[tuple[int, float, float, float]]:
        found = []
        for k, known in self.short.items():
            if len(words) >= k and (k > 1 or len(words) == 1):
                own = np.unique(shingles(words, k))
                for h in own[np.isin(own, np.fromiter(known, dtype=np.uint64, count=len(known)))].tolist():
                    found += [(i, 1.0, 1.0, 1.0) for i in known[h]]
        return found

    def _searched(self, words: np.ndarray) -> list[tuple[int, float, float, float]]:
        if len(words) < MIN_WORDS or not len(self.terms):
            return []
        pairs = shingles(words, 2)
        at = np.searchsorted(self.terms, pairs)
        at[at == len(self.terms)] = 0
        places = np.flatnonzero(self.terms[at] == pairs)
        if not len(places):
            return []
        hits, step = at[places], places // self.span
        sums = np.bincount(step, weights=self.most[hits], minlength=int(step[-1]) + 2)
        best: dict[int, float] = {}
        for k in np.flatnonzero(sums[:-1] + sums[1:] >= SHARE - 1e-9).tolist():
            lo, hi = np.searchsorted(step, [k, k + 2])
            for item, score in self.search(np.unique(hits[lo:hi]).tolist()):
                best[item] = max(score, best.get(item, 0.0))
        if not best:
            return []
        own = np.unique(shingles(words, 5))
        share = lambda part: float(np.isin(part, own).mean())
        rows = ((i, s, share(self.question[i]), share(self.answer[i])) for i, s in sorted(best.items()))
        return [r for r in rows if r[2] >= OVERLAP and r[3] >= OVERLAP]


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes over ``items`` (item_id, text), each within the bound."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    if shards == 1:
        yield Index(_collected(items))
        return
    terms = written(items.select("text").mapInArrow(_terms, "term long, words long"))
    n, mean = terms.where("words > 0").agg(F.count("*"), F.coalesce(F.avg("words"), F.lit(0.0))).first()
    often = written(terms.where("words = 0").groupBy("term").agg(F.count("*").alias("df")))
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        own = part.select("text").mapInArrow(_terms, "term long, words long").where("words = 0").select("term").distinct()
        rows = often.join(own, "term", "left_semi").collect()  # terms of one shard
        found = np.array([r.term for r in rows], dtype=np.int64).view(np.uint64)
        order = np.argsort(found)
        yield Index(_collected(part), (n, mean, found[order], np.array([r.df for r in rows], dtype=np.int64)[order]))


def _collected(part: DataFrame) -> list[tuple[int, str]]:
    return [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]  # at most about ``SHARD_BYTES``


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item of ``MIN_WORDS`` words or more: a row with their number, and one for each distinct term."""
    for batch in batches:
        for words in hashed_texts(batch.column("text"), ALNUM, lower=True):
            if len(words) >= MIN_WORDS:
                terms = np.unique(shingles(words, 2)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, 0)), pa.array(np.append(np.zeros(len(terms), dtype=np.int64), len(words)))], ["term", "words"])


def _found(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    index = index.value
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        ids = batch.column("doc_id")
        for i, words in enumerate(hashed_texts(batch.column("text"), ALNUM, lower=True)):
            for item, *numbers in index.leaks(words):
                for column, value in zip(out, (ids[i].as_py(), index.ids[item], *numbers), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(pa.array(x, pa.float64()) for x in out[2:])], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each item that each document leaks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(items):
        part = docs.mapInArrow(partial(_found, index=docs.sparkSession.sparkContext.broadcast(index)), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    index = index.value
    for batch in batches:
        clean = pa.array([not index.leaks(words) for words in hashed_texts(batch.column("text"), ALNUM, lower=True)], pa.bool_())
        yield batch.select(["d"]).filter(clean)


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak nothing, with the columns of the input."""
    for index in indexes(items):
        rows = docs.select(whole(docs).alias("d"), F.col("text"))
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = rows.mapInArrow(partial(_clean, index=shared), T.StructType([T.StructField("d", docs.schema)])).select("d.*")
    return docs


def op6(spark, sf_dir: str) -> DataFrame:
    out = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("score", 6).alias("score"), "question_overlap", "answer_overlap")


def _windows_sql(w: str, k: int) -> str:
    return f"list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i+{k - 1}], ' '))"


#: What ``docs(doc_id, text)`` of unique ids leaks of ``benchmark``, by scores of all items for all passages.
SQL = rf"""
d_items AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
d_long AS (SELECT *, len(w) AS n, greatest({MIN_WORDS}, len(w) // 3) AS tail FROM d_items WHERE len(w) >= {MIN_WORDS}),
d_all AS (SELECT count(*) AS items, avg(n) AS mean, greatest({MIN_SPAN}, COALESCE(max(n), 0)) AS span FROM d_long),
d_pairs AS (SELECT item_id, n, term, count(*) AS tf FROM (SELECT item_id, n, unnest({_windows_sql('w', 2)}) AS term FROM d_long) GROUP BY item_id, n, term),
d_often AS (SELECT term, count(*) AS df FROM d_pairs GROUP BY term),
d_impacts AS (SELECT item_id, term, ln(1 + (items - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1}::DOUBLE / (tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * n / mean)) AS x FROM d_pairs JOIN d_often USING (term), d_all),
d_shares AS MATERIALIZED (SELECT item_id, term, x / sum(x) OVER (PARTITION BY item_id) AS x FROM d_impacts),
d_docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM docs),
d_hits AS (SELECT doc_id, i // span AS step, g[i+1] AS term FROM (SELECT doc_id, g, unnest(range(0, len(g))) AS i FROM (SELECT doc_id, {_windows_sql('w', 2)} AS g FROM d_docs WHERE len(w) >= {MIN_WORDS})), d_all),
d_passages AS (SELECT DISTINCT doc_id, unnest([step, step - 1]) AS k, term FROM d_hits WHERE term IN (SELECT term FROM d_often)),
d_scores AS (SELECT doc_id, k, item_id, sum(x) AS score FROM d_passages JOIN d_shares USING (term) WHERE k >= 0 GROUP BY doc_id, k, item_id HAVING sum(x) >= {SHARE} - 1e-9),
d_best AS (SELECT doc_id, item_id, max(score) AS score FROM d_scores GROUP BY doc_id, item_id),
d_parts AS (SELECT *, w[1:greatest({MIN_WORDS}, n - tail)] AS q, w[n-tail+1:n] AS a FROM d_long),
d_runs AS (SELECT item_id, list_distinct({_windows_sql('q', 5)}) AS q, list_distinct({_windows_sql('a', 5)}) AS a FROM d_parts),
d_own AS (SELECT doc_id, {_windows_sql('w', 5)} AS g FROM d_docs WHERE doc_id IN (SELECT doc_id FROM d_best)),
d_overlaps AS (SELECT doc_id, item_id, score, len(list_intersect(q, g))::DOUBLE / len(q) AS question_overlap, len(list_intersect(a, g))::DOUBLE / len(a) AS answer_overlap FROM d_best JOIN d_runs USING (item_id) JOIN d_own USING (doc_id)),
d_short AS (SELECT doc_id, item_id FROM d_docs d JOIN d_items s ON len(s.w) BETWEEN 1 AND {MIN_WORDS - 1} AND (len(s.w) > 1 OR len(d.w) = 1) AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(s.w, ' ') || ' ')),
d_leaks AS (
  SELECT doc_id, item_id, round(score, 6) AS score, question_overlap, answer_overlap FROM d_overlaps WHERE question_overlap >= {OVERLAP} AND answer_overlap >= {OVERLAP}
  UNION ALL SELECT doc_id, item_id, 1.0, 1.0, 1.0 FROM d_short)
"""
OP6_SQL = "WITH docs AS (SELECT doc_id, text FROM documents), " + SQL + """
SELECT doc_id, item_id, score, question_overlap, answer_overlap FROM d_leaks
"""
