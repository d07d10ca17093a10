"""Toxicity: a noisy channel restores obfuscated words, a linear model scores the restored text.

1. A character language model: trigrams over ``a``-``z``, a gap and a class for other letters, counted over all characters of
   all texts (each task sends its counts, which are summed). A table of fixed size suffices, as a path through a lattice is
   only held against other readings of the same few characters.
2. Restoring: a word's characters open a lattice. Letters stand for themselves, look-alikes for letters, repeated letters
   for one or two, separators for nothing, other characters at an edge for punctuation; between two words of a text a gap
   may stand for nothing as well. Costs of the channel and of the language model add up along a path. Two exact Viterbi
   searches find the cheapest reading: one keeps the best path for every place and last two classes; the other, for words
   that are known from the training sample, for every place and node of their trie. A known word wins within
   ``KNOWN_BONUS``. Words of letters alone, none doubled, have a lattice of one path; a pair of letters is
   read as one only towards a known word. Words that a text has split by gaps are sought for the features that raise a score, over any
   number of gaps; such a reading wins if it costs less than its pieces. No length ends the decoding.
3. Scoring: a logistic model over the presence of words, fitted on at most ``TRAIN_ROWS`` labelled rows whose
   crc32(doc_id as text) mod 5 is not 0, in order of a seeded hash. Its features are the ``FEATURES`` words whose share
   among toxic rows differs most from that among others.

Scoring streams through ``mapInArrow``; nothing but trigram counts and labelled words is shuffled. Model and language
model have bounded size. Defined cases: null and empty texts get the score of a text without features; without labels of
both kinds all scores are the share of toxic rows, or 0.5 without rows; a doc_id labelled twice counts as toxic if one
label says so; null doc_ids are held out with no remainder, so as not held out; equal rows get equal scores; an empty table
gives an empty table; texts and words of any length are read whole, in memory that follows their length; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, table, written

TRAIN_ROWS = 20_000
FEATURES = 500
MIN_ROWS = 5
#: Standard errors by which a feature's share among toxic rows must differ.
LEAST_Z = 4.0
PENALTY = 0.05
KNOWN_WORDS = 20_000
KNOWN_BONUS = 6.0
CACHE = 400_000
#: Gap, a-z, other letters.
CLASSES = 28
#: Classes of the characters of the first plane; others are gaps.
_CLASS = np.array([c - 96 if 97 <= c <= 122 else c - 64 if 65 <= c <= 90 else 27 if chr(c).isalpha() else 0 for c in range(1 << 16)], dtype=np.int32)
#: Fixed table of look-alikes.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
#: Punctuation around a word that looks like no letter.
_AROUND = ".,;:?\"'“”„‘’»«…[]{}<>)&^~=_-–—/\\`"
_SEPARATORS = set(".,-_'~^:;/\\=`\"")
_LIKE, _WILD, _SKIP, _ODD, _AT_EDGE, _GAP = 0.7, 1.6, 0.7, 3.0, 0.4, 0.8
#: Characters that aren't letters or digits, at an edge.
_MARKS = "".join(chr(c) for c in range(33, 0x2100) if not chr(c).isalnum())
_RUN = re.compile(r"(.)\1")
_LONG_RUN = re.compile(r"(.)\1\1")


def counted(docs: DataFrame) -> DataFrame:
    """(code, n): character trigrams of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, dtype=np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows:
                    held.append(batch.column(0)[i].as_py() or "")
                    size += len(held[-1])
                if size > 1 << 20 or i == batch.num_rows:
                    data = "  " + "  ".join(held) + "  "
                    for at in range(0, len(data), 1 << 20):
                        code = np.frombuffer(data[at : at + (1 << 20) + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                        c = _CLASS[np.where(code < 1 << 16, code, 0)]
                        total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
                    held, size = [], 0
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) of each trigram's last character, smoothed by its bigram's."""
    n = np.zeros(CLASSES**3)
    for r in counted(docs).collect():  # at most CLASSES ** 3 rows
        n[r.code] = r.n
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two = n.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5)
    return -np.log(p3)


class _Classes(dict):
    """Classes of characters, looked up once each."""

    def __missing__(self, c: str) -> int:
        self[c] = out = int(_CLASS[ord(c)]) if ord(c) < 1 << 16 else 0
        return out


_CLASS_OF = _Classes()


def _arcs(word: str, i: int) -> list[tuple[int, str, float]]:
    """Arcs of the lattice of a word from place ``i`` on: (next place, characters written, channel cost)."""
    c, j = word[i], i + 1
    while j < len(word) and word[j] == c:
        j += 1
    run = j - i
    if c.isalpha():
        if run == 1:
            return [(j, c, 0.0)]
        return [(j, c, 0.5 if run > 2 else 2.5), (j, c * 2, 0.7 if run > 2 else 0.0)]
    out = []
    like = LOOKALIKES.get(c, "")
    for x in like:
        cost = _WILD if len(like) > 2 else _LIKE
        out.append((i + 1, x, cost))
        if run > 1:
            out.append((j, x, cost + 0.5))
    at_edge = (i == 0 or j == len(word)) and not c.isdigit()
    out.append((j, "", _AT_EDGE if at_edge else _SKIP if c in _SEPARATORS else _ODD))
    return out


_NONE: dict[int, float] = {}


class Trie:
    """Words as a trie whose edges carry the language model's costs."""

    def __init__(self, words: Iterable[str], costs: list):
        self.edges: dict[tuple[int, str], tuple[int, float]] = {}
        self.ends: dict[int, tuple[str, float]] = {}
        made = 0
        for w in sorted(words):
            node, x, y = 0, 0, 0
            for c in w:
                k = _CLASS_OF[c]
                if (node, c) not in self.edges:
                    made += 1
                    self.edges[node, c] = (made, costs[x][y][k])
                node, x, y = self.edges[node, c][0], y, k
            self.ends[node] = (w, costs[x][y][0])

    def read(self, word: str, states: dict[int, float]) -> dict[int, float]:
        """The cheapest cost of every node that the whole lattice of ``word`` leads to."""
        get, n, first = self.edges.get, len(word), 0
        if len(states) == 1:  # places with one arc, up to the first of several
            ((node, cost),) = states.items()
            for c, after in zip(word, word[1:] + "\0"):
                if c == after or not c.isalpha():
                    break
                edge = get((node, c))
                if edge is None:
                    return {}
                node, more = edge
                cost += more
                first += 1
            states = {node: cost}
        at = {first: states}
        for i in range(first, n):
            here = at.pop(i, None)
            if not here:
                if not at:
                    break
                continue
            for j, put, own in _arcs(word, i):
                there = at.setdefault(j, {})
                for node, cost in here.items():
                    cost += own
                    for c in put:
                        edge = get((node, c))
                        if edge is None:
                            break
                        node, more = edge
                        cost += more
                    else:
                        if cost < there.get(node, math.inf):
                            there[node] = cost
        return at.get(n, {})

    def ended(self, states: dict[int, float]) -> tuple[float, str] | None:
        """(cost, word) of the cheapest state that is a whole word."""
        found = [(cost + self.ends[node][1], self.ends[node][0]) for node, cost in states.items() if node in self.ends]
        return min(found, default=None)


class Restorer:
    def __init__(self, costs: np.ndarray, known: frozenset[str] = frozenset(), features: frozenset[str] = frozenset()):
        self.costs, self.known, self.features = costs.tolist(), known, features
        self.trie, self.split = Trie(known, self.costs), Trie(features, self.costs)
        #: restored word, its cost (on demand), nodes of the features' trie that the token leads to from its root
        self.cache: dict[str, tuple[str, float | None, dict[int, float]]] = {}

    def __reduce__(self):
        return Restorer, (np.array(self.costs), self.known, self.features)

    def spelled(self, text: str) -> float:
        """The language model's cost of a word."""
        x, y, total = 0, 0, 0.0
        for c in text:
            k = _CLASS_OF[c]
            total += self.costs[x][y][k]
            x, y = y, k
        return total + self.costs[x][y][0]

    def decode(self, word: str) -> tuple[float, str]:
        """(cost, text) of the cheapest path through the lattice of ``word`` that writes anything; exact."""
        # the best path to each state (last two classes) of a place; paths share their nodes, so dead ones are freed
        best: dict[int, dict[tuple[int, int, bool], tuple[float, tuple | None]]] = {0: {(0, 0, False): (0.0, None)}}
        costs = self.costs
        for i in range(len(word)):
            here = best.pop(i, None)
            if not here:
                continue
            for j, put, own in _arcs(word, i):
                there = best.setdefault(j, {})
                for (x, y, any_), (cost, path) in here.items():
                    cost += own
                    for c in put:
                        k = _CLASS_OF[c]
                        cost += costs[x][y][k]
                        x, y = y, k
                    key = (x, y, any_ or bool(put))
                    if key not in there or cost < there[key][0]:
                        there[key] = (cost, (path, put) if put else path)
        ends = [(cost + costs[x][y][0], n, path) for n, ((x, y, any_), (cost, path)) in enumerate(best.get(len(word), {}).items()) if any_]
        if not ends:
            return math.inf, word
        cost, _, path = min(ends, key=lambda e: e[:2])
        out = []
        while path is not None:
            path, put = path
            out.append(put)
        return cost, "".join(reversed(out))

    def _entry(self, token: str) -> tuple[str, float | None, dict[int, float]]:
        out = self.cache.get(token)
        if out is None:
            out = (*self._read(token), self._start(token))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[token] = out
        return out

    def read(self, token: str) -> tuple[str, float]:
        """(restored word, its cost) of a lower-case token; the empty string if nothing of it is a word."""
        text, cost, _ = self._entry(token)
        if cost is None:  # of plain words only on demand
            cost = self.spelled(text) - KNOWN_BONUS * (text in self.known)
        return text, cost

    def word(self, token: str) -> str:
        return self._entry(token)[0]

    def _read(self, token: str) -> tuple[str, float | None]:
        core = token.strip(_AROUND)
        if not core:
            return "", 0.0
        if core.isalpha() and not _RUN.search(core):
            return core, None
        bare = core.strip(_MARKS)
        if bare.isalpha() and not _LONG_RUN.search(bare):
            text, cost = bare, None
        elif any(c.isalpha() for c in core):
            cost, text = self.decode(core)
            cost -= KNOWN_BONUS * (text in self.known)
        else:  # a number or signs
            text, cost = bare, _ODD * len(core)
        found = self.trie.ended(self.trie.read(core, {0: 0.0})) if self.known else None
        if found is not None and found[1] != text:
            if cost is None:
                cost = self.spelled(text) + _AT_EDGE * (bare != core) - KNOWN_BONUS * (text in self.known)
            if found[0] - KNOWN_BONUS < cost:
                return found[1], found[0] - KNOWN_BONUS
        return text, cost

    def _start(self, token: str) -> dict[int, float]:
        core = token.strip(_AROUND)
        if not core or not self.features or core[0].isalpha() and (0, core[0]) not in self.split.edges:
            return _NONE
        out = self.split.read(core, {0: 0.0})
        out.pop(0, None)
        return out or _NONE

    def joined(self, tokens: list[str], live: set[str]) -> list[tuple[int, int, str]]:
        """(first, behind the last, word) of features that gaps split: those apart from each other that save most cost.
        ``live`` are the tokens that a feature may begin with."""
        found: list[tuple[int, int, str, float]] = []
        for i, token in enumerate(tokens) if live else ():
            if token not in live:
                continue
            states, j, before = self._entry(token)[2], i + 1, token.strip(_AROUND)
            while j < len(tokens):
                core = tokens[j].strip(_AROUND)
                if not core:
                    break
                gone = {n: c + _GAP for n, c in states.items()}
                states = self.split.read(core, gone)
                if core == before and len(core) == 1:  # a letter repeated over gaps
                    states |= {n: c for n, c in gone.items() if c < states.get(n, math.inf)}
                if not states:
                    break
                before = core
                j += 1
                end = self.split.ended(states)
                if end is not None:
                    saved = sum(self.read(t)[1] for t in tokens[i:j]) - end[0] + KNOWN_BONUS
                    if saved > 0:
                        found.append((i, j, end[1], saved))
        if len(found) < 2:
            return [f[:3] for f in found]
        found.sort(key=lambda f: (f[1], f[0]))
        ends = [f[1] for f in found]
        best: list[tuple[float, int]] = [(0.0, 0)]  # saved with the first k; how many of them stand before the last taken
        for k, (i, _, _, saved) in enumerate(found):
            before = bisect.bisect_right(ends, i, hi=k)
            with_it = best[before][0] + saved
            best.append((with_it, before) if with_it > best[k][0] else (best[k][0], -1))
        out, k = [], len(found)
        while k:
            if best[k][1] < 0:
                k -= 1
            else:
                out.append(found[k - 1][:3])
                k = best[k][1]
        return out[::-1]

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text."""
        tokens = (text or "").lower().split()
        get, out, live = self.cache.get, set(), set()
        for t in set(tokens):
            entry = get(t) or self._entry(t)
            out.add(entry[0])
            if entry[2]:
                live.add(t)
        if live and (joined := self.joined(tokens, live)):
            gone = {k for i, j, _ in joined for k in range(i, j)}
            out = {self.word(t) for k, t in enumerate(tokens) if k not in gone} | {w for _, _, w in joined}
        out.discard("")
        return out

    def text(self, text: str | None) -> str:
        """A whole text with its words restored, joined by spaces."""
        tokens = (text or "").lower().split()
        out, at = [], 0
        for i, j, w in [*self.joined(tokens, {t for t in tokens if self._entry(t)[2]}), (len(tokens), len(tokens), "")]:
            out += [*map(self.word, tokens[at:i]), w]
            at = j
        return " ".join(w for w in out if w)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _sampled(labels: DataFrame, rows: int) -> DataFrame:
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return labels.where(remainder(F.col("doc_id")) != 0).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)


def _worded(batches: Iterator[pa.RecordBatch], restorer) -> Iterator[pa.RecordBatch]:
    restorer = restorer.value
    for batch in batches:
        words = [sorted(restorer.words(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], ["toxic", "words"])


def _fitted(rows: list[tuple[int, list[int]]], width: int) -> np.ndarray:
    """Weights and, last, the intercept of a logistic model with a quadratic penalty, by Newton's steps."""
    x = np.zeros((len(rows), width + 1), dtype=np.float64)
    x[:, -1] = 1
    for i, (_, at) in enumerate(rows):
        x[i, at] = 1
    y = np.array([t for t, _ in rows], dtype=np.float64)
    w, penalty = np.zeros(width + 1), np.full(width + 1, PENALTY)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, weights: dict[str, float], intercept: float, restorer: Restorer):
        self.weights, self.intercept, self.restorer = weights, intercept, restorer

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.intercept + sum(get(w, 0.0) for w in sorted(self.restorer.words(text) & self.weights.keys()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sc = docs.sparkSession.sparkContext
    costs = language_model(docs)
    sample = written(_sampled(labels, rows))
    texts = docs.select("doc_id", "text").join(small(sample, rows), "doc_id")
    worded = written(texts.select("toxic", "text").mapInArrow(partial(_worded, restorer=sc.broadcast(Restorer(costs))), "toxic int, words array<string>"))
    per_word = worded.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_ROWS)
    per_word = written(per_word)
    n, t = (x or 0 for x in worded.agg(F.count("*"), F.sum("toxic")).first())
    known = frozenset(r.word for r in per_word.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).collect())
    if not 0 < t < n:
        share = t / n if n else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, math.log(share / (1 - share)), Restorer(costs, known))
    rate = F.lit(t / n)
    z = F.abs(F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    words = [r.word for r in per_word.where(z >= LEAST_Z).orderBy(F.desc(z), "word").limit(FEATURES).collect()]
    if not words:
        return Model({}, math.log(t / (n - t)), Restorer(costs, known))
    place = F.create_map(*[x for i, w in enumerate(words) for x in (F.lit(w), F.lit(i))])
    wanted = F.array(*[F.lit(w) for w in words])
    data = [(r.toxic, r.at) for r in worded.select("toxic", F.transform(F.array_intersect("words", wanted), lambda w: F.element_at(place, w)).alias("at")).collect()]  # at most ``rows``
    w = _fitted(data, len(words))
    return Model(dict(zip(words, w[:-1].tolist(), strict=True)), float(w[-1]), Restorer(costs, known | set(words), frozenset(x for x, v in zip(words, w[:-1], strict=True) if v > 0)))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        scores = pa.array([model.score(t.as_py()) for t in batch.column("text")], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.mapInArrow(partial(_scored, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def restored(docs: DataFrame, restorer: Restorer) -> DataFrame:
    """doc_id and the whole restored text."""
    shared = docs.sparkSession.sparkContext.broadcast(restorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([shared.value.text(t.as_py()) for t in batch.column("text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
