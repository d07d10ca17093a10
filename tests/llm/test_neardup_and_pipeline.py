import os
import random
import re
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkgauge.llm import mixing, neardup, quality
from sparkgauge.llm.common import written
from sparkgauge.llm.components import components

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_native_operators import _plain_linededup as plain_linededup  # noqa: E402
from test_scanning_operators import plain_leaks  # noqa: E402

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def sets_of(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_groups(rows, k, percent=80):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        lowest[r] = min(lowest.get(r, 2**63), 2**63 - 1 if d is None else d)
    return [lowest[find(i)] for i in range(len(rows))], [len(s) for s in sets]


def corpus(seed, edits):
    """Families of near copies at every distance around the threshold, exact copies, a shared passage, odd rows."""
    rng = random.Random(seed)
    rows, passage = [], words(rng, 60)
    for _ in range(12):
        base = words(rng, rng.choice([8, 40, 150]))
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, max(1, int(len(w) * edits)))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 2)] = words(rng, rng.randint(0, 2))
            rows.append(" ".join(w))
    rows += [" ".join(passage + words(rng, rng.randint(10, 80))) for _ in range(60)] + [rows[0]] * 30 + [rows[0].upper(), "", None, "  ", "one", "ONE", "one two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("k", "edits"), [(2, 0.12)])
def test_groups_against_all_pairs(spark, k, edits):
    rows = corpus(k, edits)
    want, sizes = plain_groups(rows, k)
    got = {r.k: r for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert [got[i].root for i, _ in rows] == want and [got[i].n for i, _ in rows] == sizes


def test_blocks_and_crowded_buckets_lose_no_link(spark, monkeypatch):
    """With small blocks, and with all buckets of three or more taken around their centres."""
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", 300)
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK_SETS", 16)
    rows = corpus(11, 0.12)
    want, _ = plain_groups(rows, 2)
    got = {r.k: r.root for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert [got[i] for i, _ in rows] == want


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8):
        agree = []
        for _ in range(40):
            a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            shared = int(2 * j / (1 + j) * 1000)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, 1000 - shared, dtype=np.uint64)])
            x, y = neardup.packed(neardup.minima(a)), neardup.packed(neardup.minima(b))
            slots = [(int(p) >> s & 3) == (int(q) >> s & 3) for p, q in zip(x, y, strict=True) for s in range(0, 64, 2)]
            agree.append((np.mean(slots) - 0.25) / 0.75)
        assert np.mean(agree) == pytest.approx(j, abs=0.03)


def test_one_of_each_group_stays(spark):
    rng = random.Random(4)
    a, b = " ".join(words(rng, 50)), " ".join(words(rng, 50))
    rows = [(5, a), (3, a + " more"), (3, a + " more"), (9, b), (None, b), (None, " ".join(words(rng, 30))), (1, None), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS kt", "3 AS d", "4 AS n", "5 AS cid", "6 AS `a.b`")
    out = neardup.keep(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 9), (True, 0)]
    assert neardup.keep(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = written(stage(spark, rows, SF))
        if name != "mix_sources":
            assert rows.columns == columns
            now = rows.count()
            assert 0.5 * before < now <= before
            before = now
    assert set(columns) < set(rows.columns)
    out = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.copy, r.text) for r in df.collect())
    assert key(out) == key(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_of_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [docs.limit(0), docs.limit(3).selectExpr("doc_id", "CAST(NULL AS string) AS text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars"), docs.limit(2).withColumn("text", F.repeat(F.lit("aß "), 200_000))]
    for rows in (written(odd[0].unionByName(odd[1]).unionByName(odd[2])), written(odd[0])):
        for _, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, SF))
        assert rows.count() == 0


def _plain_components(sets: list[set], percent: int) -> list[int]:
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("changes,base", [(9, True), (12, True), (7, False), (30, True)])
def test_a_family_around_a_centre(spark, changes, base):
    """Near copies that are mostly unlike each other, with their model and without, against all pairs."""
    rng = random.Random(changes)
    model = [f"w{rng.randrange(900)}" for _ in range(100)]
    texts = [model] if base else []
    while len(texts) < 400:
        words = list(model)
        for at in rng.sample(range(100), rng.randint(1, changes)):
            words[at] = f"w{rng.randrange(900)}"
        texts.append(words[: rng.choice((100, 100, 95, 80))])
    want = _plain_components([set(zip(w, w[1:])) for w in texts], 80)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = {r.k: r.root for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == dict(enumerate(want))


def test_blocks_count_exactly():
    """Links around a centre, whichever it is, against all pairs; every component is joined."""
    rng = np.random.default_rng(5)
    for trial in range(60):
        percent = int(rng.choice([50, 70, 80, 90]))
        centre = np.unique(rng.integers(0, 60, 40))
        sets = list({tuple(np.unique(np.where(rng.random(40) < rng.choice([0.05, 0.15, 0.5]), rng.integers(0, 90, 40), rng.choice(centre, 40)))) for _ in range(40)} - {tuple(centre)})
        block, members = neardup.Block(len(centre), percent), []
        for i, s in enumerate(sets):
            x = np.array(s)
            lacks, more = np.setdiff1d(centre, x).size, np.setdiff1d(x, centre).size
            member = (b"%d" % i, b"%d" % i, np.setxor1d(x, centre), 100 * lacks + percent * more)
            members.append(member)
            if member[3] > (100 - percent) * len(centre):
                block.add(*member)
        linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
        whole = [set(s) for s in sets]
        found = [(int(u), int(v)) for m in members if block.ids for u, v in block.links(*m)]
        assert all(linked(whole[u], whole[v]) for u, v in found)
        near = [i for i, s in enumerate(whole) if linked(s, set(centre.tolist()))]
        root = {i: i for i in range(len(sets))}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in [*found, *zip(near, near[1:])]:
            root[find(u)] = find(v)
        assert all(find(i) == find(j) for i in range(len(sets)) for j in range(i) if linked(whole[i], whole[j])), trial


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run_against_plain_stages(spark):
    """The whole pipeline on whole tables: SQL for the rules and the mix, all runs of lines, all pairs of texts, all windows."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.sql("WITH docs AS (SELECT doc_id, source, text FROM documents), " + quality.SQL + " SELECT doc_id, source, text FROM q_judged WHERE kept ORDER BY doc_id").fetchall()
    left = plain_linededup([(d, t) for d, _, t in rows])
    rows = [(d, s, left[d][0]) for d, s, _ in rows if left[d][0].split() or not left[d][1]]
    lowest, sizes = plain_groups([(d, t) for d, _, t in rows], 2)
    rows = [r for r, low, n in zip(rows, lowest, sizes, strict=True) if low == r[0] or not n]
    leaks = {d for d, _ in plain_leaks([(d, t) for d, _, t in rows], con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())}
    rows = [r for r in rows if r[0] not in leaks]
    kept = pd.DataFrame(rows, columns=["doc_id", "source", "text"])  # noqa: F841 the SQL reads it
    want = []
    for d, text, size, times, extra in con.sql("WITH docs AS (SELECT doc_id, source, text FROM kept)" + mixing.SQL + " SELECT doc_id, text, size, whole, extra FROM mix_rows").fetchall():
        want += [(d, k + 1, text) for k in range(times if size else 0)]
        if extra:
            want.append((d, times + 1, text if extra == size else " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)[:extra])))
    got = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted(want) and leaks and len(rows) > 50
