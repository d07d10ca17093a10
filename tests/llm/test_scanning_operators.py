import gzip
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkgauge.llm import chat, decontam, extraction, hashing, toxicity, warc
from sparkgauge.llm.common import shared_dir, written

# hashing


def test_word_hashes_do_not_depend_on_segments(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, " a  b\tc ", "ÀÉ é", "x" * 300, *[" ".join("".join(rng.choice("abcAZé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80))) for _ in range(50)]]
    whole = [h.tolist() for h in hashing.hashed_texts(pa.array(texts))]
    monkeypatch.setattr(hashing, "SEGMENT", 64)
    monkeypatch.setattr(hashing, "CHUNK", 100)
    hashing._POWERS.clear()
    assert [h.tolist() for h in hashing.hashed_texts(pa.array(texts))] == whole
    hashing._POWERS.clear()
    seen = {}
    for t, hs in zip(texts, whole, strict=True):
        words = (t or "").encode().lower().split()
        assert len(words) == len(hs)
        for w, h in zip(words, hs, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# toxicity


FLAT = np.full((28, 28, 28), 3.0)


def test_restoring():
    r = toxicity.Restorer(FLAT, frozenset(["idiot", "loser", "moron", "trash", "scum"]), frozenset(["moron", "idiot"]))
    for token, want in (("1d10t", "idiot"), ("looooser", "loser"), ("m-o-r-o-n", "moron"), ("tr@$h", "trash"), ("sc*m", "scum"), ("plain,", "plain"), ("(word)", "word"), ("%%%", ""), ("été", "été"), ("word$$$", "word")):
        assert r.word(token) == want
    assert "moron" in r.words("you are a m o r o n ok") and r.words(None) == set() and r.words("a b") == {"a", "b"}
    for split in ("id iot", "idi ot", "i d i o t", "i d 1 0 t", "i di ot!", "1d io t", "i d i i i o t"):
        assert r.text(f"an {split} here") == "an idiot here", split
    assert r.text("mo ron idi ot") == "moron idiot"


def test_pieces_that_are_words_stay_apart():
    r = toxicity.Restorer(FLAT, frozenset(["there", "the", "re", "idiot"]), frozenset(["there", "idiot"]))
    assert r.text("the re idiot") == "the re idiot"


def test_restoring_without_shortcuts():
    """Doubled letters, long cores, digits alone and spaced runs of several words reach the lattice."""
    r = toxicity.Restorer(FLAT, frozenset(["idiot", "stupid", "loser", "worthless", "stupidworthlessidiot", "ass", "letter"]))
    for token, want in (("idiiot", "idiot"), ("stuupid", "stupid"), ("looser", "loser"), ("l" + "o" * 60 + "ser", "loser"), ("s.t.u.p.i.d.w.o.r.t.h.l.e.s.s.i.d.i.o.t.s"[:-2], "stupidworthlessidiot"), ("4$5", "ass"), ("2019", "2019"), ("letter", "letter"), ("1d10t-" + "i" * 200 + "diot", None)):
        assert want is None or r.word(token) == want
    three = frozenset(["stupid", "worthless", "idiot", "loser"])
    r = toxicity.Restorer(FLAT, three, three)
    assert r.words("s t u p i d w o r t h l e s s i d i o t") == {"stupid", "worthless", "idiot"}
    assert {"idiot", "loser"} <= r.words("x q " + "z y " * 60 + "i d 1 0 t " + "l " + "o " * 50 + "s e r")
    assert len(r.word("ab1" * 20_000)) >= 40_000
    assert r.word("1d" + "1" * 200 + "0t") == "idiot"


def _paths(word, i=0):
    if i == len(word):
        yield "", 0.0
        return
    for j, put, cost in toxicity._arcs(word, i):
        for rest, more in _paths(word, j):
            yield put + rest, cost + more


def test_viterbi_finds_the_cheapest_path():
    """Both searches against all paths of random lattices."""
    rng = np.random.default_rng(4)
    for _ in range(150):
        word = "".join(rng.choice(list("abil1033$*-.!oo4"), rng.integers(1, 9)))
        known = frozenset("".join(rng.choice(list("abiloes"), rng.integers(1, 6))) for _ in range(200))
        r = toxicity.Restorer(rng.random((28, 28, 28)) * 4, known)
        whole = [(c + r.spelled(t), t) for t, c in _paths(word) if t]
        if whole:
            assert abs(r.decode(word)[0] - min(whole)[0]) < 1e-9
        best, found = min(((c, t) for c, t in whole if t in known), default=None), r.trie.ended(r.trie.read(word, {0: 0.0}))
        assert (best is None) == (found is None) and (best is None or abs(best[0] - found[0]) < 1e-9)


def test_held_out_rows_of_the_tables(spark):
    """Precision and recall on the fifth of the labelled rows that is never learnt from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.scored(docs.join(marks, "doc_id", "left_semi"), toxicity.trained(docs, marks)).where("held_out").join(marks, "doc_id")
    rows = [(r.toxic, r.predicted) for r in out.collect()]
    hit, found, toxic = sum(t * p for t, p in rows), sum(p for _, p in rows), sum(t for t, _ in rows)
    print(hit, found, toxic, len(rows))
    assert hit >= 0.95 * found and hit >= 0.85 * toxic


def test_scores_separate_held_out_rows(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    bad = ["idiot", "loser", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            w = rng.choice(bad)
            words.insert(rng.randint(0, 40), w.replace("o", "0") if i % 8 == 0 else w)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(docs, toxicity.trained(docs, marks)).collect()}
    held = [i for i, _ in rows if out[i].held_out]
    assert 60 < len(held) < 200 and np.mean([out[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert out[9000].score == out[9001].score and 0 <= out[9000].score <= 1 and len(out) == 603
    blank = toxicity.trained(docs, marks.limit(0))
    assert {r.score for r in toxicity.scored(docs, blank).collect()} == {0.5}
    empty = docs.limit(0)
    assert toxicity.scored(empty, toxicity.trained(empty, marks)).count() == 0


# extraction


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<script>var a='</p>'</script><style>p{}</style>", ""),
        ("<article><h1>A &amp; B</h1><p>One\n two.<br>Three is here.<p>Four &#233; here.</article>", "A & B One two. Three is here. Four é here."),
        ("<nav><a href='/'>Home</a></nav><main><p>The text of the page is here.</p></main><footer>&copy; me</footer>", "The text of the page is here."),
        ("<body><div class='sidebar'><p>Read more of our other stories.</p></div><div id=content><p>This is the story. It goes on.</p><p>And on.</p></div><div class=comments><p>Great post! I liked it a lot.</p></div>", "This is the story. It goes on. And on."),
        ("<article><p>Main text goes here, at length.</p><aside><p>By the way, buy this.</p></aside><p>More of the text.</p><form><label>Mail</label><input></form></article>", "Main text goes here, at length. More of the text."),
        ("<article><p>Cut off in the midd", "Cut off in the midd"), ("<article><p>Cut off <b", "Cut off"), ("<article><p>a &am", "a &am"),
        ("<article><!-- <p>gone</p> --><p title='a>b'>Stays as it is.</p></article>", "Stays as it is."),
        ("<article><ul><li>First thing.<li>Second thing.</ul></article>", "First thing. Second thing."),
    ],
)
def test_extract(page, text):
    assert extraction.extract(page) == text


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="the hidden gem"', 'data-hidden="false"', 'aria-hidden="false"', "class='x' data-a='aria-hidden=true'", 'title="a > hidden"'])
def test_only_a_hidden_attribute_hides(attributes):
    page = f"<div {attributes}><article><p>The text of the page is here.</p></article></div>"
    assert extraction.extract(page) == "The text of the page is here."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "class=a hidden=until-found", "aria-hidden='true'", "aria-hidden = true", "id=x/ hidden"])
def test_hidden_attributes_hide(attributes):
    assert extraction.extract(f"<article><p>The text is here.</p><p {attributes}>This one is not shown.</p></article>") == "The text is here."


@pytest.mark.parametrize("tag", ["object", "noscript", "canvas", "audio", "video"])
def test_fallback_text_is_left_to_the_cut(tag):
    page = f"<article><p>The text of the page is here.</p><{tag}><p>And this is what it shows instead.</p></{tag}><p>Where <math><mi>x</mi></math> is small.</p></article>"
    assert extraction.extract(page) == "The text of the page is here. And this is what it shows instead. Where x is small."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side, scores=scores, edges=edges):
            return sum(-min(s, 0) if x else max(s, 0) for s, x in zip(scores, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(extraction.labels(scores, edges)) == pytest.approx(best)


def test_extracted_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Text is here.</p></article>", 5), (None, None, None, 6)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in extraction.extracted(pages).collect()) == [(0, "", 0), (1, "Text is here.", 13)]


# decontamination


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(5)
    words = ["".join(p) for p in itertools.product("abcd", repeat=2)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))) for i in range(120)]
    index = decontam.Index(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.terms)), 90))
        scores = {}
        for t in terms:
            for item, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[item] = scores.get(item, 0) + x
        for least in (0.2, 0.5):
            want = {i: s for i, s in scores.items() if s >= least}
            got = dict(index.search(terms, least))
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(20, 60))) for i in range(30)] + [(98, None), (99, "too short")]
    rows = [(i, prose(rng, 300)) for i in range(100)]
    for i in range(30):
        words = items[i][1].split()
        if i % 3 == 0:
            words[len(words) // 2] = "changed"
        rows[i] = (i, f"{prose(rng, rng.randint(0, 500))} {' '.join(words).upper() if i % 2 else ', '.join(words)} {prose(rng, 70)}")
    rows += [(200, None), (201, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score", "3 AS `a.b`")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaked(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(i, i) for i in range(30)] + [(0, 0)])
    kept = decontam.keep(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [*range(30, 100), 200, 201]
    assert decontam.keep(docs, bench.limit(0)).count() == len(rows) and decontam.leaked(docs.limit(0), bench).count() == 0


def test_index_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_BYTES", 300)
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{prose(rng, 50)} {t}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaked(docs, bench).collect()) == [(i, i) for i in range(12)]
    assert decontam.keep(docs, bench).count() == 0


# chat


def test_tool_calls(spark):
    call = lambda *cs: '{"tool_calls": [' + ", ".join(cs) + "]}"
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call('{"name": "find", "id": "a", "arguments": {"q": "x", "n": 2, "b": {"z": 1, "a": [1, 2]}}}', '{"id": "b", "name": "sum", "arguments": {"of": {"$ref": "a"}}}')),
        (1, 2, "tool", '{"tool_call_id": "b", "content": {"v": 3, "k": null}}'), (1, 3, "tool", '{"tool_call_id": "a", "content": "r"}'), (1, 4, "tool", '{"tool_call_id": "zz", "content": 1}'),
        (1, 5, "assistant", call('{"id": "c", "name": "find", "arguments": {"n": "two", "w": 1}}', '{"id": "d", "name": "none", "arguments": {}}')),
        (1, 6, "assistant", call('{"id": "e", "name": "sum", "arguments": {"of": {"$ref": "f"}}}', '{"id": "f", "name": "sum", "arguments": {"of": {"$ref": "e"}}}')),
        (1, 7, "assistant", call('{"id": "a", "name": "find", "arguments": {"q": "y"}}')), (2, 0, "tool", '{"tool_call_id": "a", "content": 1}'), (2, 1, "user", "{not json"), (2, 2, "user", None), (None, None, None, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS status", "2 AS v")
    schemas = chat.schema_table(spark, [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "b", "object", False), ("sum", "of", "object", True)])
    out = chat.formatted(messages, schemas).collect()
    by = {(r.conv_id, r.turn, r.call_id): r for r in out}
    assert len(out) == 15
    a, b = by[1, 1, "a"], by[1, 1, "b"]
    assert (a.status, a.depth, a.errors) == ("linked", 0, []) and (b.status, b.depth, b.errors) == ("linked", 1, [])
    assert a.json == '{"role":"assistant","tool_calls":[{"arguments":{"b":{"a":[1,2],"z":1},"n":2,"q":"x"},"id":"a","name":"find"}],"turn":1}'
    assert by[1, 3, "a"].order_turn == 1 and by[1, 2, "b"].order_kind == 1 and by[1, 2, "b"].json == '{"content":{"k":null,"v":3},"role":"tool","tool_call_id":"b","turn":2}'
    assert by[1, 4, "zz"].status == "orphan" and by[2, 0, "a"].status == "orphan"
    assert by[1, 5, "c"].errors == ["missing q", "type n", "unknown w"] and by[1, 5, "c"].status == "open" and by[1, 5, "d"].errors == ["unknown tool"]
    assert by[1, 6, "e"].status == by[1, 6, "f"].status == "unordered" and by[1, 7, "a"].status == "duplicate"
    assert by[2, 1, None].json == '{"content":"{not json","role":"user","turn":1}' and by[2, 2, None].json == '{"role":"user","turn":2}' and by[None, None, None].json == "{}"
    assert chat.formatted(messages.limit(0)).count() == 0


def test_fields_beside_calls_stay(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": {}, "type": "function"}], "content": "Let me look", "b": {"z": 1, "a": null}, "role": "x"}'),
        (1, 1, "tool", '{"tool_call_id": "a", "name": "f", "content": [1]}'), (1, 2, "assistant", '{"role": "assistant", "tool_calls": [{"id": "b", "name": "f", "arguments": {}}]}'),
    ]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.call_id or "", r.status, r.json) for r in out) == [
        (0, "", "message", '{"b":{"a":null,"z":1},"content":"Let me look","role":"assistant","turn":0}'),
        (0, "a", "linked", '{"role":"assistant","tool_calls":[{"arguments":{},"id":"a","name":"f","type":"function"}],"turn":0}'),
        (1, "a", "linked", '{"content":[1],"name":"f","role":"tool","tool_call_id":"a","turn":1}'),
        (2, "b", "open", '{"role":"assistant","tool_calls":[{"arguments":{},"id":"b","name":"f"}],"turn":2}'),
    ]


def test_deep_chains_of_calls(spark):
    """A chain of 300 calls, calls with several references to it and each other, and a cycle."""
    call = lambda i, refs: '{"tool_calls": [{"id": "%s", "name": "f", "arguments": %s}]}' % (i, "{" + ", ".join(f'"{k}": {{"$ref": "{r}"}}' for k, r in enumerate(refs)) + "}")  # noqa: E731, UP031
    refs = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}
    refs |= {"m": ["c299", "c7"], "n": ["m"], "o": ["n", "c3"], "p": ["q"], "q": ["p"], "r": ["q", "c1"], "s": ["none"], "t": ["q"]}
    rows = [(1, k, "assistant", call(i, r)) for k, (i, r) in enumerate(refs.items())] + [(1, 900, "tool", '{"tool_call_id": "c299", "content": 1}')]
    got = {r.call_id: (r.depth, r.status) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("role = 'assistant'").collect()}
    assert all(got[f"c{i}"][0] == i for i in range(300)) and got["c299"] == (299, "linked")
    assert [got[x][0] for x in "mno"] == [300, 301, 302] and {got[x] for x in "pqrst"} == {(-1, "unordered")}


# WARC


def test_archives_round_trip(spark):
    import base64
    import hashlib

    rows = [(3, "http://x.org/a b?q", "same"), (1, "http://x.org/b\r\nX: y", "same"), (7, None, None), (5, "http://y", ""), (9, "http://é.org/", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhé\r\n\r\n"), (2, "u", "x\n"), (2, "u", "x\n"), (None, "http://n", "same"), (None, "http://m", "alone"), (11, "http://z", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS leader")
    path = f"{shared_dir(spark)}/a"
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    got = warc.resolved(written(warc.assembled(records))).collect()
    digest = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    want = []
    for page, _, html in rows:
        leader = min((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        first = leader is None or page == leader
        want.append((page, len((html or "").encode()), digest(html), "response" if first else "revisit", None if first else leader))
    key = lambda t: (t[0] is None, t[0] or 0, t[2])
    assert sorted(((r.metadata.page_id, r.capture.payload_bytes if r.response is None else r.response.payload_bytes, r.capture.payload_digest, r.capture.kind, r.response and r.response.page_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.request is not None for r in got)
    path = f"{shared_dir(spark)}/b"
    warc.write_archives(pages, path, min_bytes=5)
    assert warc.read_records(spark, path).where("kind = 'revisit'").count() == 0
    path = f"{shared_dir(spark)}/c"
    warc.write_archives(pages.limit(0), path)
    assert warc.assembled(warc.read_records(spark, path)).count() == 0


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", "hello")], "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/d"
    warc.write_archives(pages, path)
    data = b"".join(gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").collect())
    kinds = [h["warc-type"] for h, _ in warc.parsed(data)]
    assert kinds == ["request", "response", "metadata"] and data.endswith(b"\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parsed(b"HTTP/1.1 200\r\n\r\n"))


def test_damaged_archives_stop_the_run(spark, tmp_path, monkeypatch):
    """One byte of a payload changed, and a revisit whose response is gone."""
    pages = spark.createDataFrame([(1, "http://x.org/a", "hello world"), (2, "http://x.org/b", "hello world")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "good"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "good").rglob("part-*.gz")))
    (tmp_path / "flipped").mkdir()
    (tmp_path / "flipped" / "part-0").write_bytes(data.replace(b"hello world", b"hellO world"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, str(tmp_path / "flipped")).collect()
    records = warc.read_records(spark, str(tmp_path / "good"))
    assert warc.resolved(written(warc.assembled(records))).where("response.page_id = 1").count() == 1
    with pytest.raises(Exception, match="no response"):
        warc.resolved(written(warc.assembled(records.where("kind != 'response'")))).collect()


def test_long_pages_are_written_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LONG_BYTES", 1000)
    monkeypatch.setattr(warc, "MOST_BYTES", 20_000)
    rows = [(i, None, chr(97 + i % 26) * (3000 + i if i % 5 == 0 else 10 + i)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("part-*.gz")]
    assert len(sizes) > 5 and max(sizes) < 20_000 and (tmp_path / "w" / "long").exists()
    got = {r.metadata.page_id: r.capture.payload_bytes for r in warc.assembled(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert got == {i: len(x) for i, _, x in rows}


#: Pages in the manner of several sites, with what a reader would call the article.
LABELLED = [
    ("<body><div id=top><a href=/>Home</a> <a href=/n>News</a></div><div class='page has-sidebar'><h1>Rain returns</h1><p>Intro</p><p>Rain came back on Monday. Farmers were glad about it, as the soil had been dry for weeks.</p><p>Then sun.</p><p>It will stay until Friday, the office said. After that it gets warmer.</p></div><div class='sidebar'><p>Most read</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div></body>",
     "Rain returns Intro Rain came back on Monday. Farmers were glad about it, as the soil had been dry for weeks. Then sun. It will stay until Friday, the office said. After that it gets warmer."),
    ("<main><header><h1>How to bake</h1></header><p>Take flour, water and salt. Mix them well for ten minutes.</p><aside>Buy our book. It has many recipes for you.</aside><p>Bake it.</p><p>Let it cool for an hour before you cut it. Then enjoy.</p><div class='article-comments'><p>Great recipe, thank you so much! I made it twice.</p></div></main><footer>All rights reserved.</footer>",
     "How to bake Take flour, water and salt. Mix them well for ten minutes. Bake it. Let it cool for an hour before you cut it. Then enjoy."),
    ("<div class='post-meta-content'><p>The council met on Tuesday. It voted for the new bridge, with nine votes to four.</p><p class='meta'>Against it</p><p>were the members of the river ward, who fear the noise. Work begins in spring.</p></div><div class='cookie-banner'>We use cookies. By going on you accept them.</div>",
     "The council met on Tuesday. It voted for the new bridge, with nine votes to four. Against it were the members of the river ward, who fear the noise. Work begins in spring."),
    ("<article><p title=it's>Quotes in values are no trouble. They are read as browsers do.</p><div class='side-by-side'><p>Left column text, of a sentence or so.</p><p>Right column.</p></div><form><label>Mail</label><input><button>Send</button></form></article>",
     "Quotes in values are no trouble. They are read as browsers do. Left column text, of a sentence or so. Right column."),
    ("<nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav><div><p>Prose &amp; more prose, which is long enough to be an article. It has two sentences.</p><blockquote>Short quote</blockquote><p>And a closing paragraph. That is all there is to say about it.</p></div><div class='newsletter-signup'>Get our letter. It comes weekly.</div>",
     "Prose & more prose, which is long enough to be an article. It has two sentences. Short quote And a closing paragraph. That is all there is to say about it."),
]


def test_extraction_on_labelled_pages():
    """Precision and recall in words, and pages in which the cut changes what the classifier alone would say."""
    right = found = wanted = changed = 0
    for page, want in LABELLED:
        got, words = extraction.extract(page).split(), want.split()
        common = sum((Counter(got) & Counter(words)).values())
        right, found, wanted = right + common, found + len(got), wanted + len(words)
        parts, keep = extraction.labelled(page)
        changed += keep != [extraction.score(b) > 0 for b in parts]
    assert right / found >= 0.97 and right / wanted >= 0.97 and changed >= 2, (right, found, wanted, changed)


def test_the_cut_is_the_cheapest_labelling():
    """Against all labellings of small pages of random blocks."""
    rng = random.Random(3)
    for _ in range(150):
        tags = [rng.choice(("p", "h2", "div", "li", "aside", "div class=meta", "div class=ad")) for _ in range(rng.randint(1, 9))]
        page = "".join(f"<{t}>{' '.join('word' for _ in range(rng.randint(1, 30)))}{rng.choice(('.', '', ''))}</{t.split()[0]}>" for t in tags)
        parts, keep = extraction.labelled(page)
        scores = [extraction.score(b) for b in parts]

        def cost(sides):
            own = sum(abs(x) for x, s in zip(scores, sides, strict=True) if (x > 0) != s)
            near = sum(extraction.NEAR for i in range(1, len(sides)) if sides[i] != sides[i - 1])
            last, same = {}, 0.0
            for i, b in enumerate(parts):
                if b.parent in last and sides[last[b.parent]] != sides[i]:
                    same += extraction.SAME_PARENT
                last[b.parent] = i
            return own + near + same

        best = min(cost([bool(m >> i & 1) for i in range(len(parts))]) for m in range(1 << len(parts)))
        assert abs(cost(keep) - best) < 1e-9


def test_long_and_deep_pages_are_taken_whole():
    deep = "<div>" * 20_000 + "<p>Text that is deep. It stays.</p>" + "</span></b>" * 20_000
    assert extraction.extract(deep) == "Text that is deep. It stays."
    long = "<article>" + "<p>One sentence of it. And one more.</p>" * 5_000 + "</article>"
    assert len(extraction.extract(long)) == 5_000 * 34 - 1
    assert extraction.extract("<p a=" + "'\"" * 50_000) == "" and extraction.extract("<" * 1000) is not None


def plain_leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str]]) -> dict[tuple[int, int], float]:
    """The score of every item that a document leaks, from every item's score in every window of every text."""
    split = lambda t: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    long = [(i, split(t)) for i, t in items if len(split(t)) >= decontam.MIN_WORDS]
    pairs = {i: Counter(zip(w, w[1:])) for i, w in long}
    df = Counter(p for c in pairs.values() for p in c)
    mean = sum(len(w) for _, w in long) / len(long)
    impact = {i: {p: np.log(1 + (len(long) - df[p] + 0.5) / (df[p] + 0.5)) * n * (decontam.K1 + 1) / (n + decontam.K1 * (1 - decontam.B + decontam.B * len(w) / mean)) for p, n in pairs[i].items()} for i, w in long}
    span = max(decontam.MIN_SPAN, *(len(w) for _, w in long))
    runs = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    want = {}
    for d, text in docs:
        w = split(text)
        own = list(zip(w, w[1:]))
        for i, item in long:
            best = max((sum(impact[i].get(p, 0.0) for p in set(own[k : k + 2 * span])) / sum(impact[i].values()) for k in range(0, max(len(own), 1), span)), default=0.0)
            third = max(5, len(item) // 3)
            q, a = runs(item[: max(5, len(item) - third)], 5), runs(item[-third:], 5)
            if best >= decontam.SHARE and len(q & runs(w, 5)) >= decontam.OVERLAP * len(q) and len(a & runs(w, 5)) >= decontam.OVERLAP * len(a):
                want[d, i] = round(best, 6)
        for i, t in items:
            short = tuple(split(t))
            if 0 < len(short) < decontam.MIN_WORDS and short in runs(w, len(short)) and (len(short) > 1 or len(w) == 1):
                want[d, i] = 1.0
    return want


def test_decontamination_against_all_pairs(spark, monkeypatch):
    """The whole query, in one index and in shards, against every item's score in every window of every text."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 3, 5, 9, 20, 40))))) for i in range(40)]
    docs = []
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            put = [w if rng.random() > 0.08 else rng.choice(words) for w in rng.choice(items)[1].split()]
            at = rng.randint(0, len(parts))
            parts[at:at] = put
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, items[0][1])]
    want = plain_leaks(docs, items)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 400):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        got = {(r.doc_id, r.item_id): round(r.score, 6) for r in decontam.leaked(*frames).collect()}
        assert got == want and len(want) > 30
