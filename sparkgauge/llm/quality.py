"""Quality rules: a table of thresholds compiled into one projection, without user functions.

``measures`` gives the counts of a text as expressions, ``RULES`` the table: measure, divided by another, between two
bounds, from so many words on. ``compiled`` turns both into one projection. Words are runs of ``[^\\x20\\x09-\\x0D]``.

Sorting the hashes of a text's five-word windows finds those that repeat; a text is only compared with itself, so
memory follows the longest text. Hashes have 64 bits; texts are short against that.

Defined cases: null and empty texts have no words, lines or symbols, and fail (too short); all columns of the input,
whatever their names, are held in one struct and come back unchanged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAPS, let, table, whole

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Function words of the languages that the rules are meant for.
STOP_WORDS = tuple(
    "the and of to in is that it for on with as was at by from or be are this "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "le la les de des et un une que qui dans en du est pour par sur au "
    "el los las y se del una con no para".split()
)


class Rule(NamedTuple):
    name: str
    value: str
    per: str | None
    least: float
    most: float
    from_words: int = 0


#: The method's own verdict, besides the base rule.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", 0.0, 0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.04, 1.0, 50),
    Rule("repeated_lines_per_line", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("doubled_words_per_word", "n_doubled", "n_words", 0.0, 0.2),
)


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        twice = F.filter(
            sorted_windows,
            lambda x, k: ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(sorted_windows, k + 1)["h"] == x["h"])),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.coalesce(F.least(F.get(p, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.struct(F.xxhash64(F.slice(words, i + 1, WINDOW)).alias("h"), i.alias("i")))
    return F.when(F.size(words) > WINDOW, let(F.sort_array(windows), covered)).otherwise(0).cast("long")


def measures(text: Column) -> Column:
    """One struct of all counts."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    words = F.filter(F.split(text, GAPS, -1), lambda x: x != "")

    def counts(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, GAPS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.contains("!"))).cast("long").alias("n_shouts"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).cast("long").alias("n_doubled"),
        )

    return let(words, lambda w: let(lines, lambda ls: counts(w, ls)))


def verdict(m: Column, rules=RULES) -> tuple[Column, Column]:
    """(base_failed, kept) of a struct of counts."""
    base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    kept = ~base
    for r in rules:
        value = m[r.value] if r.per is None else m[r.value] / F.greatest(m[r.per], F.lit(1))
        kept = kept & ((m["n_words"] < r.from_words) | value.between(r.least, r.most))
    return base, kept


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """A struct ``d`` of the input's columns, a struct ``m`` of counts, base_failed and kept."""
    out = docs.select(whole(docs).alias("d"), measures(docs["text"]).alias("m"))
    base, kept = verdict(F.col("m"), rules)
    return out.select("d", "m", base.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that the rules keep, with the columns of the input."""
    return judged(docs, rules).where("kept").select("d.*")


def op2(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("d.doc_id", *[F.col(f"m.{n}").alias(n) for n in names], "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: The counts and verdicts of ``docs(doc_id, text)``.
SQL = rf"""
q_words AS (
  SELECT *, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
q_windows AS (
  SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS g FROM q_words),
q_sorted AS (
  SELECT *, list_sort(list_transform(range(1, len(g) + 1), lambda i: {{'h': g[i], 'i': i}})) AS s FROM q_windows),
q_twice AS (
  SELECT *, list_sort(list_transform(list_filter(range(1, len(s) + 1), lambda k: (k > 1 AND s[k-1].h = s[k].h) OR (k < len(s) AND s[k+1].h = s[k].h)), lambda k: s[k].i)) AS p FROM q_sorted),
q_counts AS (
  SELECT * EXCLUDE (w, ls, g, s, p), len(w)::BIGINT AS n_words,
    length(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(COALESCE(text, '')) - length(translate(COALESCE(text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    COALESCE(list_sum(list_transform(range(1, len(p) + 1), lambda k: least(5, COALESCE(p[k+1] - p[k], 5)))), 0)::BIGINT AS n_repeat_words,
    len(ls)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP})))::BIGINT AS n_stop_words,
    len(list_filter(w, lambda x: contains(x, '!')))::BIGINT AS n_shouts,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1]))::BIGINT AS n_doubled FROM q_twice),
q_base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM q_counts),
q_judged AS (SELECT *, NOT base_failed
    """ + "\n    ".join(
    f"AND ({f'n_words < {r.from_words} OR ' if r.from_words else ''}{r.value}" + (f"::DOUBLE / greatest({r.per}, 1)" if r.per else "") + f" BETWEEN {r.least} AND {r.most})" for r in RULES
) + " AS kept FROM q_base)"
OP2_SQL = "WITH docs AS (SELECT doc_id, text FROM documents), " + SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged
"""
