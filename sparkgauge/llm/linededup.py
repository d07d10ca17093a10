"""Line dedup by content-defined runs of lines.

A run counts that holds ``MIN_WORDS`` words or more and is several lines or one of ``LONG_WORDS`` words. Of every line with
words the shortest such run that starts with it, and the shortest that ends with it, are hashed and counted over all
documents. Their borders depend on their own lines alone, so a passage gives the same runs wherever it stands, and those
inside it cover all its lines with words: what counts and repeats is found whole, to its edges, however short its lines
are. Where a run occurs in two documents or more, its first occurrence (by doc_id, then place) stays and all others are
removed, after their bytes have been compared. An occurrence that overlaps the first loses what is behind the first.

All is native. Hashes are counted as narrow rows. A bitmap of bounded size of the hashes that repeat lets the bytes of
their runs through, which are grouped by hash and bytes with a partial aggregate before the shuffle, so that a hot
passage collapses; hashes that several texts share are told apart by the texts. A second bitmap lets the documents
through that lose lines: the texts of those alone are shuffled.

Defined cases: null and empty texts have no runs and stay as they are; lines without words between lost lines go
with them, others stay; null doc_ids come last; rows equal in doc_id and
text count as one document and stay equal; a document of which no word is left gets an empty text; other columns, whatever
their names, stay in the struct ``d``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAPS, WORD, bitmap, let, maybe, table, whole, written

LONG_WORDS = 20
MIN_WORDS = 15
_LAST = 2**63 - 1


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, GAPS, -1), lambda x: x != ""))


def chunks(text: Column) -> Column:
    """Array of what runs are made of, the single lines: lines (array), words."""
    return F.when(F.length(text) > 0, F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.array(x).alias("lines"), _words(x).alias("words"))))


def _reach(words: Column, worded: Column, first: Column) -> Column:
    """The last line of the shortest run that counts from line ``first`` on, through the next lines with words."""

    def longer(run: Column, line: Column) -> Column:
        enough = (run["n"] >= MIN_WORDS) & (run["at"] != first)
        return F.when(enough, run).otherwise(F.struct((run["n"] + F.get(words, line)).alias("n"), line.alias("at")))

    run = F.aggregate(worded, F.struct(F.lit(0).alias("n"), first.alias("at")), longer)
    return let(run, lambda r: F.when((r["n"] >= MIN_WORDS) & (r["at"] != first), r["at"]))


def runs(text: Column) -> Column:
    """Array of the shortest runs that count: place, size, body."""

    def spans(words: Column) -> Column:
        return let(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) > 0), lambda at: ends(words, at))

    def ends(words: Column, at: Column) -> Column:
        def found(line: Column, beside: Column, worded: Column) -> Column:
            n = F.get(words, line)
            alone = (n >= MIN_WORDS) & (F.get(words, beside) == 0)  # beside a line without words
            return F.when(n >= LONG_WORDS, line).when(alone, beside).otherwise(_reach(words, worded, line))

        def packed(first: Column, last: Column) -> Column:
            return F.shiftleft(first.cast("long"), 32) + (last - first + 1)

        # every line of these has a word, so MIN_WORDS of them are enough
        down = F.transform(at, lambda x, i: packed(x, found(x, x + 1, F.slice(at, i + 1, MIN_WORDS))))
        up = F.transform(at, lambda x, i: packed(found(x, x - 1, F.reverse(F.slice(at, F.greatest(i - (MIN_WORDS - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(MIN_WORDS))))), x))
        return F.filter(F.array_distinct(F.concat(down, up)), lambda x: x.isNotNull())

    def bodies(cs: Column) -> Column:
        return let(F.flatten(cs["lines"]), lambda lines: F.transform(spans(cs["words"]), lambda x: one(lines, F.shiftright(x, 32).cast("int"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int"))))

    def one(lines: Column, place: Column, size: Column) -> Column:
        return F.struct(place.alias("place"), size.alias("size"), F.array_join(F.slice(lines, place + 1, size), "\n").alias("body"))

    return let(chunks(text), bodies)


def body_hash(body: Column) -> Column:
    return F.xxhash64(body)


def deduped(docs: DataFrame) -> DataFrame:
    """``docs`` in a struct ``d``, with the text that is left (``text``) and the number of lines that are gone (``n_removed``)."""
    rows = docs.select(whole(docs).alias("d"))
    rows = rows.withColumn("k", F.coalesce(F.col("d.doc_id").cast("long"), F.lit(_LAST))).withColumn("kt", F.xxhash64("d.text"))
    cut = rows.where(F.length("d.text") > 0).select("k", "kt", F.inline(runs(F.col("d.text"))))
    cut = cut.select("k", "kt", "place", "size", body_hash(F.col("body")).alias("h"), "body")
    seen = written(cut.select("k", "kt", "place", "size", "h"))
    who = F.struct("k", "kt")
    often = seen.groupBy("h").agg(F.min(who).alias("a"), F.max(who).alias("b")).where("a != b").select("h")

    # byte comparison: runs whose hash repeats, grouped by their bytes
    alike = maybe(cut, "h", bitmap(written(often), "h")).where("maybe").groupBy("h", "body")
    alike = alike.agg(F.min(F.struct("k", "kt", "place")).alias("first"), F.max(who).alias("last"))
    alike = written(alike.select("h", F.md5("body").alias("bytes"), "first", (F.struct("first.k", "first.kt") != F.col("last")).alias("repeats")))
    texts = alike.groupBy("h").agg(F.count("*").alias("texts"), F.first("first").alias("first"), F.max("repeats").alias("repeats"))
    texts = written(texts.where("repeats"))
    behind = F.when((F.col("k") == F.col("first.k")) & (F.col("kt") == F.col("first.kt")), F.col("first.place") + F.col("size")).otherwise(0)
    lost = ["k", "kt", F.greatest("place", behind).alias("at"), (F.col("place") + F.col("size")).alias("to")]
    gone = seen.join(texts.where("texts = 1"), "h").select(*lost)
    mixed = texts.where("texts > 1")
    if not mixed.isEmpty():  # one hash, several texts
        apart = cut.join(mixed.select("h"), "h", "left_semi").withColumn("bytes", F.md5("body"))
        gone = gone.unionByName(apart.join(alike.where("repeats"), ["h", "bytes"]).select(*lost))

    # what is left of a document lies between the lost runs: before each one that starts behind all earlier ones, and at the end
    earlier = Window.partitionBy("k", "kt").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    gone = gone.where("at < to").withColumn("free", F.coalesce(F.max("to").over(earlier), F.lit(0)))
    between = F.when(F.col("at") > F.col("free"), F.struct("free", (F.col("at") - F.col("free")).alias("size")))
    gone = written(gone.groupBy("k", "kt").agg(F.sort_array(F.collect_list(between)).alias("left"), F.max("to").alias("to")))

    touched = maybe(rows, "kt", bitmap(gone, "kt"))
    untouched = touched.where("NOT maybe").select("d", F.col("d.text").alias("text"), F.lit(0).cast("long").alias("n_removed"))
    out = touched.where("maybe").join(gone, ["k", "kt"], "left")

    def rest(lines: Column) -> Column:
        pieces = F.transform("left", lambda x: F.struct(x["free"].alias("free"), F.slice(lines, x["free"] + 1, x["size"]).alias("lines")))
        inner = F.flatten(F.filter(pieces, lambda x: (x["free"] == 0) | F.array_join(x["lines"], "\n").rlike(WORD))["lines"])
        kept = F.concat(inner, F.slice(lines, F.col("to") + 1, F.size(lines) - F.col("to")))
        return let(kept, lambda x: let(F.array_join(x, "\n"), lambda t: F.when(t.rlike(WORD), F.struct(t.alias("text"), (F.size(lines) - F.size(x)).alias("n"))).otherwise(F.struct(F.lit("").alias("text"), F.size(lines).alias("n")))))

    left = out.select("d", F.when(F.col("to").isNotNull(), let(F.split("d.text", "\n", -1), rest)).alias("rest"))
    text = F.when(F.col("rest").isNull(), F.col("d.text")).otherwise(F.col("rest.text"))
    return untouched.unionByName(left.select("d", text.alias("text"), F.coalesce("rest.n", F.lit(0)).cast("long").alias("n_removed")))


def keep(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left go. Columns as in the input."""
    out = deduped(docs)
    gone = (F.col("n_removed") > 0) & (F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(0)) == 0)
    names = docs.columns
    return out.where(~gone).select(*[F.col("text") if n == "text" else F.col(f"d.`{n}`").alias(n) for n in names])


def op9(spark, sf_dir: str) -> DataFrame:
    out = deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("d.doc_id", "text", "n_removed")


#: What is left of ``docs(doc_id, text)`` of unique ids.
SQL = rf"""
l_texts AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs WHERE text <> ''),
l_lines AS MATERIALIZED (SELECT doc_id, i - 1 AS i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l_texts)),
l_worded AS MATERIALIZED (SELECT *, sum(n) OVER w AS c, row_number() OVER w AS r FROM l_lines WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l_near AS (
  SELECT a.doc_id, a.i, a.n, b.i AS j, b.r > a.r AS below, abs(b.c - a.c) + CASE WHEN b.r > a.r THEN a.n ELSE b.n END AS words
  FROM l_worded a JOIN l_worded b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r - {MIN_WORDS} AND a.r + {MIN_WORDS} AND b.r <> a.r),
l_reach AS (SELECT doc_id, i, min(j) FILTER (WHERE below AND words >= {MIN_WORDS}) AS down, max(j) FILTER (WHERE NOT below AND words >= {MIN_WORDS}) AS up FROM l_near GROUP BY doc_id, i),
l_ends AS (
  SELECT w.doc_id, w.i, CASE WHEN w.n >= {LONG_WORDS} THEN w.i WHEN w.n >= {MIN_WORDS} AND next.n = 0 THEN w.i + 1 ELSE down END AS down,
    CASE WHEN w.n >= {LONG_WORDS} THEN w.i WHEN w.n >= {MIN_WORDS} AND prev.n = 0 THEN w.i - 1 ELSE up END AS up
  FROM l_worded w LEFT JOIN l_reach r ON r.doc_id = w.doc_id AND r.i = w.i
  LEFT JOIN l_lines next ON next.doc_id = w.doc_id AND next.i = w.i + 1 LEFT JOIN l_lines prev ON prev.doc_id = w.doc_id AND prev.i = w.i - 1),
l_runs AS (SELECT doc_id, i AS place, down - i + 1 AS size FROM l_ends WHERE down IS NOT NULL UNION SELECT doc_id, up, i - up + 1 FROM l_ends WHERE up IS NOT NULL),
l_bodies AS MATERIALIZED (SELECT r.*, array_to_string(ls[place+1:place+size], chr(10)) AS body FROM l_runs r JOIN l_texts USING (doc_id)),
l_twice AS (SELECT body, min(doc_id) AS first_id, arg_min(place, (doc_id, place)) AS first_place FROM l_bodies GROUP BY body HAVING min(doc_id) <> max(doc_id)),
l_spans AS (SELECT doc_id, greatest(place, CASE WHEN doc_id = first_id THEN first_place + size ELSE 0 END) AS lo, place + size AS hi FROM l_bodies JOIN l_twice USING (body)),
l_lost AS (SELECT DISTINCT doc_id, unnest(range(lo, hi)) AS i FROM l_spans WHERE lo < hi),
l_left AS (SELECT l.*, x.i IS NOT NULL AS lost, l.i - row_number() OVER (PARTITION BY l.doc_id, x.i IS NULL ORDER BY l.i) AS piece, max(l.i) OVER (PARTITION BY l.doc_id) AS last FROM l_lines l LEFT JOIN l_lost x ON x.doc_id = l.doc_id AND x.i = l.i),
l_pieces AS (SELECT *, lost OR (min(i) OVER p > 0 AND max(i) OVER p < last AND max(n) OVER p = 0) AS out FROM l_left WINDOW p AS (PARTITION BY doc_id, lost, piece)),
l_rest AS (SELECT doc_id, bool_or(lost) AS cut, COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT out), '') AS rest, count(*) AS lines, count(*) FILTER (WHERE out) AS gone, COALESCE(bool_or(n > 0) FILTER (WHERE NOT out), false) AS worded FROM l_pieces GROUP BY doc_id),
l_done AS (
  SELECT docs.* REPLACE (CASE WHEN NOT COALESCE(cut, false) THEN text WHEN worded THEN rest ELSE '' END AS text),
    CASE WHEN NOT COALESCE(cut, false) THEN 0 WHEN worded THEN gone ELSE lines END::BIGINT AS n_removed FROM docs LEFT JOIN l_rest USING (doc_id))
"""
OP9_SQL = "WITH docs AS (SELECT doc_id, text FROM documents), " + SQL + """
SELECT doc_id, text, n_removed FROM l_done
"""
