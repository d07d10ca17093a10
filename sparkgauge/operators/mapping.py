"""Mapping of column names onto reference fields, with a score for each pair and its reasons.

Up to ``ALL_PAIRS`` pairs of names are scored one and all. Larger catalogs go through ``candidates``: equi-joins that find
every pair whose score can matter to a decision, by an upper bound for each part of the score.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import normalized, tokens
from ..functions.ratio import sequence_ratio
from ..functions.types import NUMERIC
from ..sources.files import stored
from .semantic import semantic_types

#: Other names of fields.
SYNONYMS = {
    "email": ["mail", "e-mail", "contact_email", "email_address", "user_email"],
    "phone": ["tel", "telephone", "mobile", "cell", "contact_number", "phone_number", "phonenumber"],
    "address": ["addr", "location", "residence", "street", "street_address", "postal_address"],
    "city": ["town", "municipality"],
    "state": ["province", "region", "territory"],
    "zip": ["zipcode", "zip_code", "postal_code", "postcode"],
    "country": ["nation", "land"],
    "id": ["identifier", "uuid", "pk", "key", "record_id", "user_id", "customer_id"],
    "name": ["fullname", "full_name", "display_name"],
    "first_name": ["fname", "given_name"],
    "last_name": ["lname", "surname", "family_name"],
    "gender": ["sex"],
    "dob": ["date_of_birth", "birth_date", "birthday"],
    "price": ["cost", "amount", "value", "rate", "fee", "charge"],
    "date": ["timestamp", "created_at", "updated_at", "datetime"],
}
#: Scores and boosts.
NORM_EXACT, SYNONYM, SHORT_PENALTY, DTYPE_BOOST, CONTENT_BOOST = 0.98, 0.97, -0.02, 0.02, 0.5
THRESHOLD, EPSILON = 0.72, 0.03
MAX_CANDIDATES = 5
#: Pairs of names up to which all are scored, with the references sent to all tasks.
ALL_PAIRS = 1_000_000


def merged_synonyms(user: dict[str, Iterable[str]] | None = None) -> dict[str, list[str]]:
    """The default table with a user's lists; the default stays as it is."""
    out = {k: list(v) for k, v in SYNONYMS.items()}
    for k, v in (user or {}).items():
        out.setdefault(k, []).extend(x for x in v if x not in out.get(k, []))
    return out


def source_names(df: DataFrame, order_by: Sequence[str] | None = None, content: bool = True, detected: dict[str, str] | None = None) -> DataFrame:
    """(source, numeric, detected) of a table's columns; ``detected`` is the semantic type of their values, given by column where it
    is known."""
    spark = df.sparkSession
    rows = [(i, f.name, isinstance(f.dataType, NUMERIC)) for i, f in enumerate(df.schema.fields)]
    names = spark.createDataFrame(rows, "place int, source string, numeric boolean")
    if detected is not None:
        known = F.map_from_arrays(F.array(*map(F.lit, detected)), F.array(*map(F.lit, detected.values()))) if detected else F.create_map().cast("map<string,string>")
        return names.withColumn("detected", known[F.col("source")])
    if not content or not any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        return names.withColumn("detected", F.lit(None).cast("string"))
    found = semantic_types(df, order_by).withColumnRenamed("semantic_type", "detected")
    return names.join(F.broadcast(found), names["source"] == found["column"], "left").drop("column")


def names_only(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, source string")
    return df.select("place", "source", F.lit(False).alias("numeric"), F.lit(None).cast("string").alias("detected"))


def reference_names(spark: SparkSession, references: Sequence[str], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(ref_place, ref, aliases) with the aliases of the name or of its normalised form."""
    table = spark.createDataFrame([(k, list(v)) for k, v in (synonyms or SYNONYMS).items()], "name string, own array<string>")
    refs = spark.createDataFrame([(i, r) for i, r in enumerate(references)], "ref_place int, ref string").withColumn("ref_n", normalized(F.col("ref")))
    direct = refs.join(F.broadcast(table), F.col("ref") == F.col("name"), "left").withColumnRenamed("own", "a").drop("name")
    both = direct.join(F.broadcast(table), F.col("ref_n") == F.col("name"), "left").withColumnRenamed("own", "b").drop("name")
    return both.select("ref_place", "ref", "ref_n", F.coalesce("a", "b", F.array().cast("array<string>")).alias("aliases"))


def _jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _parsed(sources: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = sources.withColumn("src_n", normalized(F.col("source"))).withColumn("src_t", tokens(F.col("source")))
    return s, references.withColumn("ref_t", tokens(F.col("ref"))).withColumn("alias_n", F.transform("aliases", normalized))


def components(sources: DataFrame, references: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every pair, or those of ``pairs`` (place, ref_place), of a source and a reference name with the parts of its score,
    those of ``sequence_ratio`` apart."""
    s, r = _parsed(sources, references)
    pairs = s.crossJoin(r) if pairs is None else s.join(pairs, "place").join(r, "ref_place")
    synonym = F.array_contains("aliases", F.col("source")) | F.array_contains("alias_n", F.col("src_n")) | F.arrays_overlap("src_t", "alias_n")
    short = (F.size("src_t") == 1) & (F.length(F.get("src_t", F.lit(0))) <= 2) & (F.col("src_n") != F.col("ref_n"))
    detected_n = normalized(F.col("detected"))
    content = (detected_n == F.col("ref_n")) | F.array_contains("alias_n", detected_n)
    score = lambda test, value: F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(0.0)
    return pairs.select(
        "place", "source", "ref_place", "ref", "src_n", "ref_n",
        score(F.col("source") == F.col("ref"), 1.0).alias("exact"),
        score(F.col("src_n") == F.col("ref_n"), NORM_EXACT).alias("norm_exact"),
        score(synonym, SYNONYM).alias("synonym"),
        _jaccard(F.col("src_t"), F.col("ref_t")).alias("jaccard"),
        score(short, SHORT_PENALTY).alias("length_penalty"),
        score(F.col("numeric"), DTYPE_BOOST).alias("dtype_boost"),
        score(content, CONTENT_BOOST).alias("pattern_boost"),
    )


def scores(sources: DataFrame, references: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Every pair, or those of ``pairs``, with all parts, base and final score."""
    rows = components(sources, references, pairs).withColumn("seq", sequence_ratio("src_n", "ref_n"))
    rows = rows.withColumn("base", F.greatest("exact", "norm_exact", "synonym", "jaccard", "seq"))
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("base") + F.col("dtype_boost") + F.col("pattern_boost") + F.col("length_penalty")))
    return rows.withColumn("final", final)


def _elements(text: Column) -> Column:
    """The characters of a text, each with its number among the equal ones before it."""
    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c)).cast("string")))


def _prefixes(s: DataFrame, r: DataFrame) -> DataFrame:
    """(place, ref_place) of the sets ``set`` of ``s`` and ``r`` that share an element among their first ones.

    ``least`` is a share: fewer common elements than that share of either set rule a pair out. Sets are ordered by how rare
    their elements are, so two sets that have as many in common share one among those that may be missing and one more.
    """
    rows = s.select("place", F.lit(None).cast("int").alias("ref_place"), "set", "least").unionByName(r.select(F.lit(None).cast("int").alias("place"), "ref_place", "set", "least"))
    each = rows.select("*", F.size("set").alias("size"), F.explode("set").alias("e"))
    counts = each.groupBy("e").agg(F.count("*").alias("n"))
    order = Window.partitionBy("place", "ref_place").orderBy("n", "e")  # the elements of one name
    kept = each.join(counts, "e").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.col("least") - 1e-9) + 1)
    mine, theirs = kept.where("place IS NOT NULL").select("place", "e"), kept.where("ref_place IS NOT NULL").select("ref_place", "e")
    return mine.join(theirs, "e").select("place", "ref_place").distinct()


def candidates(sources: DataFrame, references: DataFrame, least: float) -> DataFrame:
    """(place, ref_place) of all pairs whose final score can be ``least`` (above the boost by type) or more, and few others.

    Without a boost by content, which an equi-join finds, one part of the base must make up for ``least``: names equal as normalised
    and synonyms are equi-joins; a Jaccard score, or a sequence ratio, of ``t`` asks for a share of common tokens, or
    characters, that prefixes filter. The ratio is bounded by the characters both names have, 2 * common / all.
    """
    if least - DTYPE_BOOST <= 0:
        raise ValueError("the least score must be above the boost by type")
    s, r = _parsed(sources, references)
    s = s.withColumn("t", F.lit(least) - F.when(F.coalesce("numeric", F.lit(False)), DTYPE_BOOST).otherwise(0.0))
    low = least - DTYPE_BOOST
    det_n = normalized(F.col("detected"))

    def joined(mine: Column, theirs: Column) -> DataFrame:
        a = s.select("place", F.explode(F.array_distinct(mine)).alias("key")).where("key IS NOT NULL")
        b = r.select("ref_place", F.explode(F.array_distinct(theirs)).alias("key")).where("key IS NOT NULL")
        return a.join(b, "key").select("place", "ref_place")

    out = joined(F.array("src_n"), F.array("ref_n")).unionByName(joined(F.array("source"), F.col("aliases"))).unionByName(joined(F.concat(F.array("src_n"), F.col("src_t")), F.col("alias_n")))
    out = out.unionByName(joined(F.array(det_n), F.concat(F.array("ref_n"), F.col("alias_n"))))
    # Jaccard >= t: at least t of each set's tokens are common
    tokened = _prefixes(s.select("place", F.array_distinct("src_t").alias("set"), F.col("t").alias("least")), r.select("ref_place", F.array_distinct("ref_t").alias("set"), F.lit(low).alias("least")))
    # ratio >= t: common >= t * (a + b) / 2 with b >= a * t / (2 - t), so at least t / (2 - t) of each name's characters are common
    share = lambda t: t / (2 - t)
    spelt = _prefixes(s.select("place", _elements(F.col("src_n")).alias("set"), share(F.col("t")).alias("least")), r.select("ref_place", _elements(F.col("ref_n")).alias("set"), F.lit(share(low)).alias("least")))
    common = F.size(F.array_intersect(_elements(F.col("src_n")), _elements(F.col("ref_n"))))
    spelt = spelt.join(s.select("place", "src_n", "t"), "place").join(r.select("ref_place", "ref_n"), "ref_place")
    spelt = spelt.where(2.0 * common >= (F.col("t") - 1e-9) * (F.length("src_n") + F.length("ref_n"))).select("place", "ref_place")
    return out.unionByName(tokened).unionByName(spelt).distinct()


def decisions(scored: DataFrame, sources: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, force: bool = False) -> DataFrame:
    """(source, status, target, score, reason, candidates) of every source.

    Below the threshold a source is unmapped. With a second candidate within ``epsilon`` it is ambiguous, unless forced or
    unless both names are equal but for case; else it is mapped.
    """
    order = Window.partitionBy("source").orderBy(F.desc("final"), "ref_place")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("final").over(order)).withColumn("next_ref", F.lead("ref").over(order))
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= MAX_CANDIDATES, F.struct("rank", F.col("ref").alias("target"), F.col("final").alias("score")))))
    reason = F.struct("exact", "norm_exact", "synonym", "jaccard", "seq", "length_penalty", "dtype_boost", "pattern_boost", "base", "final")
    first = F.max(F.when(F.col("rank") == 1, F.struct("ref", "final", "next", "next_ref", reason.alias("reason")))).alias("first")
    best = ranked.groupBy("source").agg(first, top.alias("candidates"))
    rows = sources.select("place", "source").join(best, "source", "left")
    close = F.coalesce(F.col("first.final") - F.col("first.next") <= epsilon, F.lit(False)) & (F.lower("first.ref") != F.lower("first.next_ref")) & F.lit(not force)
    status = F.when(F.col("first").isNull() | (F.col("first.final") < threshold), "unmapped").when(close, "ambiguous").otherwise("mapped")
    rows = rows.withColumn("status", status)
    mapped = F.col("status") == "mapped"
    return rows.select(
        "place", "source", "status", F.when(mapped, F.col("first.ref")).alias("target"), F.when(mapped, F.col("first.final")).alias("score"), F.when(mapped, F.col("first.reason")).alias("reason"),
        F.when(F.col("status") == "ambiguous", F.transform("candidates", lambda c: F.struct(c["target"].alias("target"), c["score"].alias("score")))).alias("candidates"),
    )


def decided(sources: DataFrame, references: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON, force: bool = False, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """The decisions on all sources, as over all pairs. Beyond ``all_pairs`` pairs only candidates are scored; an ambiguous source that
    has fewer of them than a decision lists is then scored against all references."""
    n = references.count()
    least = threshold - (0.0 if force else max(epsilon, 0.0))
    if sources.count() * n <= all_pairs or least - DTYPE_BOOST <= 0:
        return decisions(scores(sources, references), sources, threshold, epsilon, force)
    rows = stored(scores(sources, references, candidates(sources, references, least)))
    found = decisions(rows, sources, threshold, epsilon, force)
    if force:
        return found
    found = stored(found)
    listed = rows.where(F.col("final") >= least).groupBy("place").agg(F.count("*").alias("listed"))
    short = found.where("status = 'ambiguous'").join(listed, "place", "left").where(F.coalesce("listed", F.lit(0)) < min(MAX_CANDIDATES, n)).select("place")
    few = stored(sources.join(short, "place", "left_semi"))
    again = decisions(scores(few, references), few, threshold, epsilon, force)
    return found.join(short, "place", "left_anti").unionByName(again)


def map_columns(
    df: DataFrame | None = None, columns: Sequence[str] | None = None, references: Sequence[str] = (), synonyms: dict[str, Iterable[str]] | None = None,
    threshold: float = THRESHOLD, epsilon: float = EPSILON, force: bool = False, spark: SparkSession | None = None, order_by: Sequence[str] | None = None,
    detected: dict[str, str] | None = None,
) -> DataFrame:
    """Decisions for a table's columns, or for names alone, which have no boosts by type or content. Semantic types that are known
    already (``detected``) aren't sought again."""
    if df is None and columns is None:
        raise ValueError("Either a table or column names must be given")
    spark = df.sparkSession if df is not None else spark or SparkSession.active()
    sources = source_names(df, order_by, detected=detected) if df is not None else names_only(spark, columns)
    if columns is not None and df is not None:
        sources = sources.where(F.col("source").isin(list(columns)))
    references = list(references)
    table = reference_names(spark, references, merged_synonyms(synonyms))
    names = len(df.columns if df is not None else columns)
    if names * len(references) <= ALL_PAIRS:  # known without a count
        return decisions(scores(sources, F.broadcast(table)), sources, threshold, epsilon, force)
    return decided(sources, table, threshold, epsilon, force, ALL_PAIRS)


def dynamic_references(tables: dict[str, Sequence[str]], name: str, user: Sequence[str] = ()) -> list[str]:
    """A user's references and all columns of other tables that this one doesn't have, sorted."""
    own = set(tables[name])
    others = {c for t, names in tables.items() if t != name for c in names}
    return sorted(set(user) | (others - own))


def dynamic_references_frame(names: DataFrame, table: str) -> DataFrame:
    """The same over (table, column) rows."""
    own = names.where(F.col("table") == table).select("column")
    return names.where(F.col("table") != table).select("column").distinct().join(own, "column", "left_anti")
