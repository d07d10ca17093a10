"""The corpus pipeline: five stages from documents to a mixed training corpus.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet in the shared
folder and gives it to the next. All but the last return the columns of documents; the last returns a row per copy that
the mix takes, with those columns and ``copy``.

ORACLE_SQL chains the operators' SQL, which compares all pairs; a test also holds ``run`` against a plain version.

Defined cases of all stages: an empty table gives an empty table with the same columns; nulls in any column pass, a null
text counts as empty; equal rows are treated alike; other columns, whatever their names, pass unchanged, but for
``n_chars``, which follows the text; texts are worked on whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import decontam, linededup, mixing, neardup, quality
from sparkgauge.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts, and those of under ten words, go; there are no ties."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that an earlier one has, by doc_id (null last), then by hash of the text; those of
    which no word is left go, others with null or empty texts stay."""
    return _counted(linededup.keep(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of texts alike by their sets of two-word shingles, the document of the smallest doc_id (null last,
    ties by hash of the text, one of equal rows); null and empty texts are alike to none and stay."""
    return neardup.keep(docs, k=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of ``benchmark``; null and empty texts, and all where there are no items, stay."""
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, with ``copy``. A null source is one of its own; null and empty texts have no words,
    and no copy; rows that tie at a source's border share what is left."""
    return _counted(mixing.emit(mixing.mix(docs)))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: The rows of ``run`` in DuckDB's SQL, for documents of unique ids: a table per stage, each over the one before.
ORACLE_SQL = f"""
WITH
after_rules AS MATERIALIZED (WITH docs AS (SELECT * FROM documents), {quality.SQL} SELECT doc_id, text, lang, source FROM q_judged WHERE kept),
after_lines AS MATERIALIZED (WITH docs AS (SELECT * FROM after_rules), {linededup.SQL} SELECT * EXCLUDE (n_removed) FROM l_done WHERE n_removed = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]')),
after_copies AS MATERIALIZED (
  WITH RECURSIVE docs AS (SELECT * FROM after_lines), {neardup.SQL} SELECT docs.* FROM docs JOIN n_grouped USING (doc_id) WHERE doc_id = component_id),
after_leaks AS MATERIALIZED (WITH docs AS (SELECT * FROM after_copies), {decontam.SQL} SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM d_leaks)),
mixed AS (
  WITH docs AS (SELECT * FROM after_leaks) {mixing.SQL}
  SELECT doc_id, source, text, size, whole, extra, unnest(range(1, whole + CASE WHEN extra > 0 THEN 2 ELSE 1 END)) AS copy FROM mix_rows WHERE size > 0),
cut AS (
  SELECT * REPLACE (CASE WHEN copy > whole AND extra < size THEN array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')[1:extra], ' ') ELSE text END AS text) FROM mixed)
SELECT cut.doc_id, cut.text, lang, cut.source, length(cut.text)::BIGINT AS n_chars, copy::INT AS copy FROM cut JOIN after_leaks USING (doc_id)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
