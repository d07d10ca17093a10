"""Sort-means, the filter audit and the chunk table against plain versions, SQL and the library."""

import hashlib
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkgauge.llm import audit, centroids, pieces, registry

from test_sql import compared

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", ["op11_centroids", "op12_audit"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compared(registry.QUERIES[name](spark, SF), con.execute(registry.ORACLE_SQL[name]))


# Sort-means


def plain_means(rows, dims, scale, k, rounds, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < centroids.LIMIT for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [list(q) for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        held = {}
        for _, q in kept:
            held.setdefault(near(q)[1], []).append(q)
        cs = [[sum(col) // len(held[i]) for col in zip(*held[i], strict=True)] if i in held else c for i, c in enumerate(cs)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=repr), cs


VECTORS = "id long, v array<double>, cluster string, q long"


def check_means(spark, rows, parts=3, dims=3, k=4, rounds=3):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS).repartition(parts)
    found, cs = centroids.sort_means(df, "id", "v", dims=dims, scale=256, k=k, rounds=rounds)
    got = sorted(((r.id, r.cluster, int(r.distance)) for r in found.collect()), key=repr)
    want, want_cs = plain_means(rows, dims, 256, k, rounds, "2")
    assert got == want and cs == want_cs
    return got


def test_means_with_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    rows += [(None, [0.5, 0.5, 0.5])] * 3 + [(7, [1.0, 2.0, 3.0])] * 5  # null and repeated ids, ties
    rows += [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [1.0, math.nan, 2.0]), (305, [math.inf, 0.0, 0.0]), (306, [0.0] * 4), (307, [1e300, 0.0, 0.0])]
    rows += [(400 + i, [0.25, 0.25, 0.25]) for i in range(300)]  # a third are one vector
    got = check_means(spark, rows)
    assert check_means(spark, rows, parts=1) == got and len(got) == 508


def test_means_of_whole_numbers_tie(spark):
    check_means(spark, [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate(itertools.product(range(-4, 5), repeat=2))], k=7, rounds=4)


def test_means_of_few_rows_and_of_none(spark):
    check_means(spark, [(1, [0.0, 1.0, 2.0]), (2, [0.0, 1.0, 2.0])], k=5)
    assert check_means(spark, []) == []


def test_means_beyond_doubles(spark):
    rows = [(i, [2.0**40 + i * 2.0**-3, -(2.0**41) * (i % 3), float(i)]) for i in range(60)]
    got = check_means(spark, rows, k=2)
    assert max(d for _, _, d in got) > 2**63


def test_scans_stop_early():
    """The scan leaves most centroids out, and misses none that is as near."""
    r = np.random.default_rng(3)
    cs = r.integers(-300, 300, (40, 8)).astype(float)
    x = np.concatenate([np.floor(c + r.normal(0, 12, (50, 8))) for c in cs])
    brute = ((x[:, None] - cs[None]) ** 2).sum(-1)
    seen = []
    squares, centroids._squares = centroids._squares, lambda a: (seen.append(len(a)), a)[1] ** 2 @ np.ones(8)
    try:
        best, least = centroids.nearest(x, brute.argmin(1), cs)
    finally:
        centroids._squares = squares
    assert (best == brute.argmin(1)).all() and (least == brute.min(1)).all()
    assert sum(seen) < 0.2 * brute.size
    for previous in (np.zeros(len(x), dtype=np.int64), r.integers(0, 40, len(x))):
        best, least = centroids.nearest(x, previous, cs)
        assert (best == brute.argmin(1)).all() and (least == brute.min(1)).all()


# Audit


def plain_masks(rows):
    smallest = {}
    key = lambda i: (i is None, i or 0)
    for i, _, t in rows:
        smallest[t or ""] = min(smallest.get(t or "", key(i)), key(i))
    out = []
    for i, lang, t in rows:
        t = t or ""
        w = t.encode().split()
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), key(i) > smallest[t]]
        out.append((i, lang or "", fails))
    return out


def plain_audit(rows, labels):
    """Filters applied one after another."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    masked = plain_masks(rows)
    for part in {p for _, p, _ in masked}:
        shapley = dict.fromkeys("ABCDE", 0)
        own = [(i, f) for i, p, f in masked if p == part]
        for order in itertools.permutations("ABCDE"):
            left, gone = own, []
            for step, name in enumerate(order, 1):
                at = "ABCDE".index(name)
                removed = [r for r in left if r[1][at]]
                left = [r for r in left if not r[1][at]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(f[at] for _, f in gone), sum(f[at] and sum(f) == 1 for _, f in own), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                gone = gone + removed
                shapley[name] += len(removed)
        for order in itertools.permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[name])
    return {k: tuple(v) for k, v in out.items()}


def documents(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["SHOUT", "$5", "a#b", "é x", "NASA"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 3, 99, 100, 101, 150]))) for _ in range(25)]
    texts += ["A" * 10 + "b" * 90, "x\ty\nz\x0bq\x1fr", " ".join(["one"] * 200), "long " * 40_000, "", None]
    ids = [*range(30), None, 3, 4]
    rows = [(r.choice(ids), r.choice(["en", "de", None, ""]), r.choice(texts)) for _ in range(250)]
    rows += [(r.randrange(1000), "en", texts[0]) for _ in range(120)]
    return rows, [(r.choice(ids), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(40)]


@pytest.mark.parametrize("parts", [1, 7])
def test_audit_of_odd_rows(spark, parts):
    rows, labels = documents()
    docs = spark.createDataFrame([(i, p, t, 1, "m") for i, p, t in rows], "doc_id long, lang string, text string, n int, mask string").repartition(parts)
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(found) == len(got) == 600 * 3
    assert got == plain_audit(rows, labels)


def test_audit_sends_few_entries_for_copies(monkeypatch):
    """A task joins its copies, also where it sends its texts on in between, and texts of one hash stay apart."""
    rows = [(i, "en", "same text") for i in range(5000)] + [(i, "de", f"text {i % 50}") for i in range(500)]
    random.Random(2).shuffle(rows)
    sent = list(audit._sent(rows, held=100))
    assert sum(len(v) == 4 and isinstance(v[1], dict) for _, v in sent) < 2000
    assert len({k for k, v in sent if not isinstance(v[1], dict)}) > 4000  # finished rows go everywhere
    back = list(audit._audited(sorted(sent, key=lambda kv: kv[0])))
    count = lambda rs: sorted((i, p, m & 16) for i, p, m, n in rs for _ in range(n))
    want = sorted((i, p, 16 * f[4]) for i, p, f in plain_masks(rows))
    assert count(back) == want
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda x: 7)
    assert count(audit._audited(list(audit._sent(rows, held=100)))) == want


def test_audit_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, lang string, text string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int")).collect() == []
    docs = spark.createDataFrame([("b", "x", "t"), ("a", "x", "t")], docs.schema)
    found = audit.audit(docs, spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.removed, r.good_lost) for r in found] == [(1, 1)]


# Pieces

TEXTS = [
    None, "", " ", "  ", "   ", "a", " a", "a ", "  a  b ", "▁", "▁▁x ▁", "a\tb\nc\x00d\r\n", "ﬁ Ａ　b é ​", "日本語 テキスト😀 x", "</s> <s> <unk> <0x41>",
    "x" * 3000, "word " * 500, " " * 40 + "deep", "a" + " " * 17 + "b", "the the  the", "▁▁ ▁", "� ퟿",
]


@pytest.fixture(scope="module")
def model():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def library(model):
    return pieces.sentencepiece.SentencePieceProcessor(model_proto=model)


def random_texts(n, seed=4):
    r = random.Random(seed)
    alphabet = ["a", "b", "th", "e", "ing", " ", " ", "  ", "▁", "\n", "\t", "é", "ß", "Ω", "漢", "😀", "́", "1", "2024", ".", "-", "<s>", "\x00"]
    return ["".join(r.choices(alphabet, k=r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_ids_and_texts_are_the_library_s(spark, model, most):
    texts = TEXTS + random_texts(400)
    docs = spark.createDataFrame([(i, t, [i], "d") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, d string").repartition(3)
    rows = pieces.decoded(pieces.encoded(docs, model, most=most).select("d.doc_id", "d.d", "ids", F.col("ids").alias("kept")), model).collect()
    sp = library(model)
    assert len(rows) == len(texts)
    for r in rows:
        want = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.kept == want, texts[r.doc_id]
        assert r.text == sp.decode(want) and r.d == "d"


@needs_tables
def test_op13_of_the_whole_table(spark, model):
    sp = library(model)
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op13_pieces"](spark, SF).collect()} == want


def test_table_is_bounded_and_frequent(spark, model):
    texts = spark.createDataFrame([("a a a a a a a a b b b c " + "z" * 60 + " d",)] * 5, "text string")
    found = {r.chunk: r.ids for r in pieces.distinct_chunks(texts, model, most=2).collect()}
    assert set(found) == {"a", "b"}
    assert set(r.chunk for r in pieces.distinct_chunks(texts, model).collect()) == {"a", "b", "c", "d"}
    assert found["a"] == library(model).encode("a")


def test_models_that_may_not_be_cut(model):
    def field(number, value):
        return bytes([number << 3]) + value if isinstance(value, bytes) and len(value) == 1 else bytes([number << 3 | 2, len(value)]) + value

    assert pieces.separable(model)
    assert not pieces.separable(model + field(1, field(1, "a▁b".encode())))  # one more piece
    assert not pieces.separable(model + bytes([2 << 3 | 2, 2, 3 << 3, 1]))  # another kind of model
    assert not pieces.separable(model + bytes([3 << 3 | 2, 2, 4 << 3, 1]))  # removes extra white space


def test_whole_texts_where_no_cut_is_allowed(model):
    import pyarrow as pa

    encoder = pieces.Encoder(model, False)
    assert encoder.encode(pa.array(TEXTS)).to_pylist() == [library(model).encode(t or "", add_eos=True) for t in TEXTS]


def test_no_rows(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decoded(pieces.encoded(docs, model), model).collect() == []
    only = spark.createDataFrame([("a b",)], "text string")
    assert pieces.encoded(only, model, end=False).select(F.size("ids")).collect() == [(2,)]
    assert isinstance(pieces.encoded(only, model).schema["ids"].dataType, T.ArrayType)
