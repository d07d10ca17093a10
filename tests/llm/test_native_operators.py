import collections
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import linededup, mixing, quality, urlfilter
from sparkgauge.llm.common import bitmap, maybe, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["*", "1 AS k", "2 AS kt", "'x' AS d", "3 AS h", "4 AS m", "5 AS maybe", "6 AS word", "7 AS bits", "8 AS copy", "9 AS mix_size", "10 AS u", "11 AS `a.b`"]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def corpus(spark, n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "b", "c", "hot", "hot", "hot", None])
        rows.append((i, None if i % 50 == 7 else " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 3, 10, 200]))), "en", source, 0))
    return docs_of(spark, rows)


# mixing


def filled(sizes, weights, budget=1.5, cap=2):
    """Water-filling by rounds."""
    total, out, free = budget * sum(sizes.values()), {}, dict(weights)
    while True:
        level = (total - sum(out.values())) / sum(free.values()) if free else 0
        over = [s for s in free if level * free[s] >= cap * sizes[s]]
        if not over:
            return out | {s: level * w for s, w in free.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del free[s]


def test_mixing_targets_and_taken(spark):
    docs = corpus(spark)
    rows = mixing.mix(docs).select("d.doc_id", "d.source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.mix_size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = collections.Counter()
    for r in rows:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source] and 0 <= r.mix_taken <= 2 * r.mix_size
        taken[r.source] += r.mix_taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(7)).select("d.doc_id", "mix_taken").collect()
    assert {r.doc_id: r.mix_taken for r in again} == {r.doc_id: r.mix_taken for r in rows}


def test_mix_is_emitted(spark):
    docs = corpus(spark, 80)
    mixed = mixing.mix(docs)
    out = mixing.emit(mixed)
    words = out.select(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == mixed.agg(F.sum("mix_taken")).first()[0]
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "text", "copy"]
    assert mixing.emit(mixing.mix(docs.selectExpr(*CLASH))).count() == out.count()


def test_mixing_edges(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = mixing.mix(docs_of(spark, [(1, "a b c", "", "s", 0), (1, "a b c", "", "s", 0), (None, "x", "", None, 0), (2, "", "", "t", 0)])).select("mix_target", "mix_taken", "mix_size").collect()
    assert len(rows) == 4 and all(r.mix_taken <= 2 * r.mix_size for r in rows)
    assert mixing.emit(mixing.mix(docs_of(spark, [(1, None, "", "s", 0)]))).count() == 0


# quality rules


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_measures_against_plain_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a", "ä🙂 b", "a b c d e a b c d e", "x " * 40, "a\nb\na\n\n a\n", "p\x0bq\x0cr\x85s\u2003t"]
    texts += [" ".join(rng.choice("abc") + rng.choice(["", "#", "!"]) for _ in range(rng.randint(0, 60))).replace(" b ", "\n") for _ in range(150)]
    texts.append(" ".join(str(i % 700) for i in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judged(df).select("d.doc_id", "m.*", "base_failed", "kept").collect():
        want = counted(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_keep_prose_and_columns(spark):
    prose = "the road to the mill is long and the people of the town go there with carts in autumn for flour"
    rows = [(1, prose, "en", "s", 1), (2, " ".join(w + "%%%" for w in prose.split()), "en", "s", 1), (3, " ".join(w.upper() + "!!" for w in prose.split()), "en", "s", 1), (4, " | ".join(prose.split()), "en", "s", 1)]
    docs = docs_of(spark, rows).selectExpr(*CLASH)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality.keep(docs_of(spark, [])).count() == 0


# URL filters


def plain_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_filters(spark):
    rng = random.Random(2)
    rules = [*urlfilter.RULES, ("b.c", "/x", "block"), ("c", "/xy/z", "allow"), ("a.b.c", "", "block"), ("a.b.c", "", "allow")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.net/en/x?q#f", "https://net", "https://net/", "http://ÄX.com/de/", "http://a.b.c", "x://y://z/w", "http://a\nb.net/p", "http://example.net:80/en/"]
    urls += ["http://" + ".".join(rng.choice(["a", "b", "c", "net", "org", "example"]) for _ in range(rng.randint(1, 6))) + rng.choice(["", "/", "/x", "/xy", "/xy/z", "/fr/", "/en/1"]) + rng.choice(["", "?a=/b", "#c"]) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls + urls[:50])), "page_id long, url string").selectExpr(*CLASH)
    table = written(urlfilter.rule_table(spark, rules))
    got = urlfilter.filtered(pages, table).select("d.page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls) + 50
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict((urls + urls[:50])[r.page_id], rules)
    none = written(urlfilter.rule_table(spark, rules).limit(0))
    assert urlfilter.filtered(pages, none).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0


# line dedup


def lines(seed, n, words):
    rng = random.Random(seed)
    return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(words)) for _ in range(n))


def test_repeated_passages_go_but_for_the_first(spark):
    shared, short = lines(0, 1, 60), lines(1, 14, 12)
    rows = [(i, f"{lines(100 + i, 3, 9)}\n{shared}\n{lines(200 + i, 2, 9)}", "", "", 0) for i in range(20)]
    rows += [(100 + i, f"{lines(300 + i, 2, 9)}\n{short}\n{lines(400 + i, 2, 9)}", "", "", 0) for i in range(20)]
    rows += [(500, None, "", "", 0), (501, "", "", "", 0), (502, "All rights reserved.", "", "", 0), (503, "All rights reserved.", "", "", 0), (None, shared, "", "", 0)]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.deduped(docs_of(spark, rows)).select("d.doc_id", "text", "n_removed").collect()}
    text = {r[0]: r[1] for r in rows}
    assert got[0] == (text[0], 0) and got[None] == ("", 1)
    assert all(shared not in got[i][0] and got[i][0] == text[i].replace(shared + "\n", "") for i in range(1, 20))
    assert got[100][0] == text[100]
    inner = short.split("\n")[2:-1]
    assert sum(line in got[101 + i][0] for i in range(19) for line in inner) < 0.5 * 19 * len(inner)
    assert got[500] == (None, 0) and got[501] == ("", 0) and got[503][0] == "All rights reserved."
    unique = [x for i in range(20) for x in (lines(100 + i, 3, 9) + "\n" + lines(200 + i, 2, 9)).split("\n")]
    assert all(any(x in got[i][0] for i in range(20)) for x in unique)


def test_chunks_cover_all_lines(spark):
    texts = ["\n", "a\n\nb", "", "x", lines(3, 40, 5) + "\n\n" + lines(4, 2, 50) + "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.array_join(F.flatten(linededup.chunks(F.col("text"))["lines"]), "\n").alias("again"))
    assert all(r.again == (r.text if r.text else None) for r in df.collect())


def lines_left(rows):
    """Brute force over all runs of lines that count and start and end with a word (or are one line with a gap)."""
    words = lambda xs: sum(len(x.split()) for x in xs)
    texts = [(i, t.split("\n")) for i, t in rows]
    where = collections.defaultdict(list)
    for i, ls in texts:
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                n, full = words(ls[a:b]), [x for x in ls[a:b] if x.split()]
                edges = ls[a].split() and ls[b - 1].split() or b - a == 2 and full
                if edges and n >= 15 and (b - a > 1 or n >= 20):
                    where["\n".join(ls[a:b])].append((i, a, b))
    gone = collections.defaultdict(set)
    for found in where.values():
        if len({i for i, _, _ in found}) > 1:
            first = min(found)
            for i, a, b in found:
                gone[i].update(range(max(a, first[2]) if i == first[0] else a, b))
    out = {}
    for i, ls in texts:
        lost = sorted(gone[i])
        for a, b in itertools.pairwise(lost):  # lines without words between lost lines go with them
            if not words(ls[a + 1 : b]):
                gone[i].update(range(a, b))
        left = "\n".join(x for k, x in enumerate(ls) if k not in gone[i])
        out[i] = (left, len(gone[i])) if left.split() or not lost else ("", len(ls))
    return out


def test_passages_of_short_lines_go_whole(spark):
    """Passages of 3- to 18-word lines, against brute force; lines of few letters repeat and overlap within a text too."""
    rng = random.Random(12)
    passages = [lines(900 + w, n, w) for w, n in ((3, 20), (5, 9), (6, 10), (9, 2), (12, 3), (16, 2), (18, 3), (4, 3))]
    passages += [lines(950, 4, 3) + "\n\n" + lines(951, 5, 6), lines(952, 1, 16) + "\n", lines(953, 1, 16)]
    rows = []
    for i in range(60):
        own = [lines(1000 + 10 * i + j, rng.randint(1, 3), rng.randint(1, 19)) for j in range(4)]
        rows.append((i, "\n".join(x for j in range(4) for x in (own[j], rng.choice(passages)))))
    for i in range(60, 90):
        rows.append((i, "\n".join(rng.choice(["", "a " * 8, "b " * 5, "c " * 16, "d " * 21]) for _ in range(rng.randint(1, 14)))))
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.deduped(docs_of(spark, [(i, t, "", "", 0) for i, t in rows])).select("d.doc_id", "text", "n_removed").collect()}
    want = lines_left(rows)
    assert {i: (got[i], want[i]) for i in range(60) if got[i] != want[i]} == {}
    worded = lambda t: [x for x in t[0].split("\n") if x.split()]  # noqa: E731  # lines without words beside an overlap may stay or go
    assert {i: (got[i], want[i]) for i in range(60, 90) if worded(got[i]) != worded(want[i])} == {}
    for p in passages[:7]:
        assert sum(t.count(p) for t, _ in got.values()) == 1


def test_line_dedup_keeps_columns_and_equal_rows(spark):
    body = lines(9, 2, 40)
    docs = docs_of(spark, [(1, body, "", "", 0), (1, body, "", "", 0), (2, body, "", "", 0), (3, lines(8, 2, 30), "", "", 0)]).selectExpr(*CLASH)
    out = linededup.keep(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 1, 3]
    assert linededup.keep(docs_of(spark, [])).count() == 0


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    """With every chunk under one hash, only chunks of equal bytes are removed."""
    import pyspark.sql.functions as real

    a, b = lines(1, 1, 30), lines(2, 1, 30)
    docs = docs_of(spark, [(1, a, "", "", 0), (2, b, "", "", 0), (3, a, "", "", 0)])
    monkeypatch.setattr(linededup, "body_hash", lambda body: real.lit(7).cast("long") + real.length(body) * 0)
    got = {r.doc_id: r.text for r in linededup.deduped(docs).select("d.doc_id", "text").collect()}
    assert got == {1: a, 2: b, 3: ""}


def test_bitmap_never_misses(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    rows = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    out = maybe(rows, "h", bitmap(written(keys), "h"))
    assert out.where("id % 3 = 0 AND NOT maybe").count() == 0 and out.where("id % 3 <> 0 AND maybe").count() < 400
    assert maybe(rows, "h", bitmap(written(keys.limit(0)), "h")).where("maybe").count() == 0


def test_mix_of_tied_rows_is_the_same_on_any_partitioning(spark):
    """Null and repeated ids, equal rows and rows that differ in other columns alone."""
    rng = random.Random(8)
    texts = [" ".join("w" * rng.randint(1, 5) for _ in range(n)) for n in (1, 1, 2, 3, 7, 30)]
    rows = [(rng.choice([None, None, 5, 6]), rng.choice(texts), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), 0) for _ in range(400)]
    rows += [(None, "one", "en", "a", 0)] * 150
    got = []
    for parts in (1, 7, 64):
        mixed = mixing.mix(written(docs_of(spark, rows).repartition(parts)))
        got.append(sorted((repr(tuple(r.d)), r.mix_taken) for r in mixed.collect()))
        assert all(0 <= r.mix_extra <= r.mix_size for r in mixed.collect())
    assert got[0] == got[1] == got[2]
    for r in mixed.groupBy("d.source").agg(F.sum("mix_taken").alias("taken"), F.first("mix_target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


def test_rows_that_share_a_hash_come_near_the_target(spark):
    """Null doc_ids, one word each: half of the rows are taken twice."""
    docs = spark.createDataFrame([(None, "a", f"w{i % 7}") for i in range(1000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).collect()
    assert rows[0].mix_target == 1500 and abs(sum(r.mix_taken for r in rows) - 1500) < 60 and max(r.mix_taken for r in rows) == 2


def _plain_linededup(docs: list[tuple[int, str]]) -> dict[int, tuple[str, int]]:
    """Every shortest counting run from and to every line, held against all others."""
    runs = {}
    for d, text in docs:
        lines = text.split("\n")
        n = [len(x.split()) for x in lines]
        for i in (i for i in range(len(lines)) if n[i]):
            for step in (1, -1):
                j, total = i, n[i]
                while not (total >= linededup.LONG_WORDS and j == i or total >= linededup.MIN_WORDS and j != i):
                    j += step
                    if not 0 <= j < len(lines):
                        break
                    total += n[j]
                else:
                    a, b = min(i, j), max(i, j)
                    runs.setdefault("\n".join(lines[a : b + 1]), set()).add((d, a, b + 1 - a))
    lost = {d: set() for d, _ in docs}
    for places in runs.values():
        if len({d for d, _, _ in places}) > 1:
            first = min(places)
            for d, at, size in places - {first}:
                lost[d] |= set(range(max(at, first[1] + first[2]) if d == first[0] else at, at + size))
    out = {}
    for d, text in docs:
        lines, gone = text.split("\n"), lost[d]
        if gone:  # what stands between lost lines and has no words goes too
            inner = [i for i in range(min(gone), max(gone)) if i not in gone]
            for part in [list(g) for _, g in itertools.groupby(inner, key=lambda i: sum(x < i for x in gone))]:
                if not any(lines[i].split() for i in part):
                    gone |= set(part)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (kept, len(gone)) if kept.split() or not gone else ("", len(lines))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_against_all_runs(spark, seed):
    """Passages of lines of 3 to 22 words that share lines, overlap, repeat inside a document and stand among blank ones."""
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.choice((3, 5, 6, 9, 14, 15, 18, 22)))) for _ in range(14)]
    passages = [[rng.choice([*pool, *pool, ""]) for _ in range(rng.randint(2, 9))] for _ in range(8)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += rng.choice(passages)[rng.randint(0, 1) :] if rng.random() < 0.6 else [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 20))) for _ in range(rng.randint(1, 4))]
        docs.append((d, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.deduped(spark.createDataFrame(docs, "doc_id long, text string")).select("d.doc_id", "text", "n_removed").collect()}
    want = _plain_linededup(docs)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {} and sum(n for _, n in want.values()) > 40
