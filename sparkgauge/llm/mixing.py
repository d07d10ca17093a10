"""Mixing sources to target weights by capped water-filling.

Every source has a size (its words) and a weight. A budget of ``budget`` times all sizes is shared by weight; no
source gets more than ``epochs`` times its size, and what a source can't take is shared again by weight among the
others until no target is above its cap. That fixed point is computed in closed form: sources sorted by size over
weight are clamped as a prefix of that order.

A source is then repeated: the whole part of target over size for each of its documents, and for the fraction those
documents come first whose seeded hash is smallest, until the target is reached. The document at the border is taken in
part, so that each source meets its target to the word. Where several rows share the border's hash, as null or repeated
doc_ids do, each takes its share of what is left, rounded up or down by a draw from its content, so that the sum comes near the
target. Equal rows are numbered and rounded in turn; as they are interchangeable, a rerun on any partitioning gives the same rows.

The border is found by three levels of a radix search over sums of sizes, so no source is ever sorted or gathered in one
task, however large it is. All is native; rows are (source, hash, size) of 52-bit hashes.

Defined cases: null texts have size 0; a null source is a source of its own, last in order; sources of size 0 get target
0; rows that share a doc_id share a hash; texts of any length are counted whole; an empty table gives an
empty table. Columns of the input that aren't used pass through ``emit`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, whole, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = 17
_BITS = 52
_LEVEL = 10


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, seed: int) -> Column:
    """52 bits of md5, which other engines can compute as well."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, source_size, weight, target. ``sizes`` has source and size.

    The windows without a partition run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(all_rows) * F.lit(float(budget))).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("below"),
        F.sum("weight").over(after).alias("open_weight"),
    )
    level = (F.col("total") - epochs * F.col("below")) / F.col("open_weight")
    per = per.withColumn("clamped", level * F.col("weight") >= epochs * F.col("source_size"))
    per = per.withColumn("free_level", F.max(F.when(~F.col("clamped"), level)).over(all_rows))
    cap = (epochs * F.col("source_size")).cast("double")
    return per.select(
        "source", "source_size", "weight",
        F.when(F.col("clamped"), cap).otherwise(F.least(cap, F.col("free_level") * F.col("weight"))).alias("target"),
    )


def _borders(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a fraction: the border hash, what is left for it, and the size of the rows at it."""
    state = plan.where(F.col("part") > 0).select("source", F.col("part").alias("left"), F.lit(0).cast("long").alias("path"))
    shift = _BITS
    rows = sizes.where(F.col("size") > 0)
    while True:
        last = shift <= _BITS - 2 * _LEVEL
        down = 0 if last else shift - _LEVEL
        here = rows.join(small(written(state)).alias("s"), F.col("s.source").eqNullSafe(rows["source"]) & (F.shiftright(rows["h"], shift) == F.col("s.path")))
        sums = here.groupBy(rows["source"].alias("source"), "s.left", F.shiftright(rows["h"], down).alias("path")).agg(F.sum(rows["size"]).alias("size"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("path"))
        sums = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left")))
        left = F.col("left") - (F.col("upto") - F.col("size"))
        if last:
            return sums.select("source", F.col("path").alias("cut"), left.alias("cut_left"), F.col("size").alias("cut_size"))
        state, shift = sums.select("source", left.alias("left"), "path"), down


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) with ``mix_*`` columns: size, source_size, target, whole, extra, taken."""
    sizes = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")).withColumn("h", hash_of(F.col("doc_id"), seed)).select("source", "size", "h"))
    plan = written(_plan(sizes, weights, budget, epochs))
    borders = _borders(sizes, plan)
    full = plan.alias("p").join(borders.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", "b.cut", "b.cut_left", "b.cut_size")
    full = written(full)
    shared = sizes.alias("s").join(small(full).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.h") == F.col("p.cut"))).groupBy("p.source").agg(F.count("*").alias("n")).where("n > 1")
    return _apply(docs, small(full), seed, not shared.isEmpty())


def _plan(sizes: DataFrame, weights, budget: float, epochs: int) -> DataFrame:
    per = targets(sizes, weights, budget, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("whole", whole)
    part = F.least(F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.col("source_size"))
    return per.withColumn("part", part)


def _shares(tied: DataFrame, seed: int) -> DataFrame:
    """``tied``, rows at their source's border, with ``extra``: their share of what is left, in whole words.

    Equal rows have a draw in common and are numbered, within partitions and over them by a count for each, so that as many of
    them are rounded up as their shares and the draw add up to, wherever they stand.
    """
    plain = [n for n, t in tied.select("d.*").dtypes if "map<" not in t and t != "variant"]
    same = ["p_source", "content"]
    tied = tied.withColumn("content", F.xxhash64(*[F.col(f"d.`{n}`") for n in plain])).withColumn("part", F.shiftright("mix_at", 33)).withColumn("p_source", F.coalesce(F.concat(F.lit("."), F.col("d.source").cast("string")), F.lit("")))
    counts = tied.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*same, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy(*same, "part").orderBy("mix_at"))
    tied = tied.join(starts, [*same, "part"]).withColumn("place", place)
    share = F.col("cut_left") * F.col("mix_size") / F.col("cut_size")
    draw = F.pmod(F.xxhash64(F.lit(seed), "content"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    upto = lambda n: F.floor(n * (F.col("share") - F.floor("share")) + draw)
    return tied.withColumn("share", share).withColumn("extra", (F.floor("share") + upto(F.col("place")) - upto(F.col("place") - 1)).cast("long"))


def _apply(docs: DataFrame, full: DataFrame, seed: int, shared: bool) -> DataFrame:
    """``shared`` says whether several rows share the hash of a border."""
    inner = docs.select(whole(docs).alias("d"), F.monotonically_increasing_id().alias("mix_at"))
    inner = inner.withColumn("mix_size", size_of(F.col("d.text"))).withColumn("mix_h", hash_of(F.col("d.doc_id"), seed))
    out = inner.join(full.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")), "left").select("d", "mix_at", "mix_size", "mix_h", "source_size", "target", "whole", "cut", "cut_left", "cut_size")
    at_border = F.coalesce(F.col("mix_h") == F.col("cut"), F.lit(False)) & (F.col("cut_size") > 0)
    alone = F.when(F.col("mix_h") < F.col("cut"), F.col("mix_size")).when(at_border, F.col("cut_left")).otherwise(0)
    fields = ["d", "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("whole").alias("mix_whole")]
    rest = (out.where(~at_border) if shared else out).select(*fields, alone.cast("long").alias("mix_extra"))
    if shared:
        rest = rest.unionByName(_shares(out.where(at_border), seed).select(*fields, F.col("extra").alias("mix_extra")))
    return rest.withColumn("mix_taken", F.col("mix_whole") * F.col("mix_size") + F.col("mix_extra"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: a row per copy with ``copy`` from 1; the copy taken in part ends after its words.

    Where the input has a column of that name, it is called ``mix_copy``.
    """
    whole = F.when(F.col("mix_size") > 0, F.col("mix_whole")).otherwise(0).cast("int")
    copies = F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<int>"))
    copies = F.when(F.col("mix_extra") > 0, F.concat(copies, F.array(whole + 1))).otherwise(copies)
    rows = mixed.withColumn("mix_copy", F.explode(copies))
    cut = (F.col("mix_copy") > F.col("mix_whole")) & (F.col("mix_extra") < F.col("mix_size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("d.text"), F.lit(WORD), 0), 1, F.col("mix_extra").cast("int")), " ")
    fields = [n for n in mixed.schema["d"].dataType.names if n != "text"]
    return rows.select(*[F.col(f"d.`{n}`").alias(n) for n in fields], F.when(cut, head).otherwise(F.col("d.text")).alias("text"), F.col("mix_copy").alias("mix_copy" if "copy" in fields else "copy"))


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(F.col("d.doc_id").alias("doc_id"), F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


#: Rows of ``docs(doc_id, source, text)`` with what the mix takes; also the end of the pipeline's SQL.
SQL = r"""
, mix_sizes AS (
  SELECT doc_id, source, text, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17|' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM docs),
mix_per AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_sizes GROUP BY source),
mix_weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM mix_per),
mix_filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
    COALESCE(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM mix_weighed),
mix_leveled AS (SELECT *, (total - 2 * below) / open_weight AS level FROM mix_filled),
mix_clamped AS (SELECT *, level * weight >= 2 * source_size AS clamped FROM mix_leveled),
mix_free AS (SELECT *, max(CASE WHEN NOT clamped THEN level END) OVER () AS free_level FROM mix_clamped),
mix_target AS (
  SELECT source, source_size, CASE WHEN clamped THEN 2.0::DOUBLE * source_size ELSE least(2.0::DOUBLE * source_size, free_level * weight) END AS target FROM mix_free),
mix_plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM mix_target),
mix_parts AS (SELECT *, least(round(target - whole * source_size)::BIGINT, source_size) AS part FROM mix_plan),
mix_hash AS (SELECT source, h, sum(size) AS tied FROM mix_sizes GROUP BY source, h),
mix_upto AS (SELECT *, sum(tied) OVER (PARTITION BY source ORDER BY h) AS upto FROM mix_hash),
mix_rows AS (
  SELECT s.doc_id, s.source, s.text, s.size, p.source_size, p.target, p.whole,
    CASE WHEN u.upto <= p.part THEN s.size
         WHEN u.upto - u.tied < p.part THEN floor(((p.part - (u.upto - u.tied)) * s.size)::DOUBLE / u.tied)::BIGINT ELSE 0 END AS extra
  FROM mix_sizes s JOIN mix_parts p ON s.source IS NOT DISTINCT FROM p.source
  JOIN mix_upto u ON s.source IS NOT DISTINCT FROM u.source AND s.h = u.h)
"""
OP1_SQL = "WITH docs AS (SELECT doc_id, source, text FROM documents)" + SQL + """
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (whole * size + extra)::BIGINT AS taken FROM mix_rows
"""
