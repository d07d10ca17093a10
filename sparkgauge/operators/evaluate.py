"""Scores of detection, typing and mapping against a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of types that count as equal.
FAMILIES = (
    ("int", ("tinyint", "smallint", "int", "bigint", "long", "int8", "int16", "int32", "int64", "integer")),
    ("float", ("float", "double", "float32", "float64")),
    ("string", ("string", "utf8", "str", "object")),
    ("boolean", ("boolean", "bool")),
    ("time", ("date", "datetime", "timestamp", "timestamp_ntz")),
)


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _scores(rows: DataFrame, tp: Column, fp: Column, fn: Column) -> DataFrame:
    sums = rows.agg(F.coalesce(F.sum(tp), F.lit(0)).alias("tp"), F.coalesce(F.sum(fp), F.lit(0)).alias("fp"), F.coalesce(F.sum(fn), F.lit(0)).alias("fn"))
    sums = sums.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _share(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return sums.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def row_scores(detected: DataFrame, truth: DataFrame, row: str = "row") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of sets of rows, whatever method or issue they come from."""
    d = detected.select(F.col(row).alias("row")).distinct().withColumn("d", F.lit(1))
    t = truth.select(F.col(row).alias("row")).distinct().withColumn("t", F.lit(1))
    both = d.join(t, "row", "full_outer").select(F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t"))
    return _scores(both, F.col("d") * F.col("t"), F.col("d") * (1 - F.col("t")), (1 - F.col("d")) * F.col("t"))


def family(kind: Column) -> Column:
    low = F.lower(kind)
    out = low
    for name, members in FAMILIES:
        out = F.when(low.isin(*members), F.lit(name)).otherwise(out)
    return out


def schema_rows(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(column, expected, found, verdict) of (column, type) frames: correct, wrong or missing."""
    rows = truth.withColumnRenamed("type", "expected").join(found.withColumnRenamed("type", "found"), "column", "left")
    verdict = F.when(F.col("found").isNull(), "missing").when(family(F.col("found")) == family(F.col("expected")), "correct").otherwise("wrong")
    return rows.withColumn("verdict", verdict)


def schema_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """correct, total and accuracy; null without a truth."""
    rows = schema_rows(found, truth).agg(F.count_if(F.col("verdict") == "correct").alias("correct"), F.count("*").alias("total"))
    return rows.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def semantic_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of (column, semantic_type) frames. A wrong type is a false positive; a column of the truth without any
    type is a false negative. An empty truth gives 1.0 throughout if nothing was found; else there is nothing to miss, so
    recall is 1.0, and precision and f1 are 0.0."""
    both = found.withColumnRenamed("semantic_type", "f").join(truth.withColumnRenamed("semantic_type", "t"), "column", "full_outer")
    same = F.coalesce(F.col("f") == F.col("t"), F.lit(False))
    out = _scores(both, same.cast("int"), (F.col("f").isNotNull() & ~same).cast("int"), F.col("f").isNull().cast("int"))
    nothing = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    out = out.crossJoin(F.broadcast(truth.agg((F.count("*") == 0).alias("blank"))))  # one row each
    sure = {"precision": nothing, "recall": nothing | F.col("blank"), "f1": nothing}
    return out.select("tp", "fp", "fn", *[F.when(one, 1.0).otherwise(F.col(c)).alias(c) for c, one in sure.items()])


def mapping_accuracy(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """(score, total, accuracy) of decisions (source, status, target, candidates) for a truth (source, target): 1 for the
    right target, a half if it is among the candidates of an ambiguous source."""
    rows = truth.withColumnRenamed("target", "want").join(decided.select("source", "status", "target", "candidates"), "source", "left")
    point = F.when((F.col("status") == "mapped") & (F.col("target") == F.col("want")), 1.0)
    point = point.when((F.col("status") == "ambiguous") & F.exists("candidates", lambda c: c["target"] == F.col("want")), 0.5).otherwise(0.0)
    out = rows.agg(F.coalesce(F.sum(point), F.lit(0.0)).alias("score"), F.count("*").alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0))


METRICS = ("anomaly_f1", "schema_accuracy", "semantic_f1", "mapping_accuracy")


def scenario_averages(results: DataFrame) -> DataFrame:
    """Means of the four metrics by scenario over (table, scenario, metrics)."""
    return results.groupBy("scenario").agg(F.count("*").alias("tables"), *[F.avg(m).alias(m) for m in METRICS])
