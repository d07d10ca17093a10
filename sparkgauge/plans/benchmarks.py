"""Benchmarks of mapping, typing and detection on made tables, and runs over folders and schemas."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import numeric_columns
from ..operators import anomalies as A
from ..operators import degrade as D
from ..operators import evaluate as E
from ..operators import mapping as M
from ..operators.forest import isolation_forest
from ..operators.refine import inferred
from ..operators.schemas import cleaned_schema, diff_of, diff_text
from ..operators.semantic import semantic_types
from ..sources.files import csv_files, read_csv, spread, stored
from ..sources.sinks import write, write_schema_report, write_text
from . import explain
from .variants import variants

#: Fields and synonyms of the mapping benchmark.
FIELDS = ("email", "phone", "first_name", "last_name", "address", "city", "zip_code", "country", "birth_date")
FIELD_SYNONYMS = {
    "email": ["mail", "e-mail", "email_addr", "contact_mail"],
    "phone": ["telephone", "mobile", "cell", "contact_number"],
    "zip_code": ["postal_code", "zip", "postcode"],
    "birth_date": ["dob", "date_of_birth", "birthday"],
}
#: Names of the ways to write a field's name.
TRANSFORM_NAMES = ("exact", "case_upper", "case_mixed", "synonym", "prefix", "suffix", "fuzzy_typo")
PREFIX, SUFFIX = "user_", "_val"
#: Abbreviated names, their fields and what they are about; the fields to choose from.
ABBREVIATIONS = (
    ("cust_id", "customer_id", "table of buyers"),
    ("first_nme", "first_name", "user personal info"),
    ("zipcode", "postal_code", "address info"),
    ("purch_amt", "purchase_amount", "transaction details"),
    ("email_addr", "email", "contact data"),
    ("dlvry_dt", "delivery_date", "shipping data"),
    ("lng", "longitude", "gps coordinates"),
    ("lat", "latitude", "gps coordinates"),
    ("fgm", "field_goals_made", "basketball player stats"),
    ("fga", "field_goals_attempted", "basketball player stats"),
    ("fg3m", "three_point_made", "basketball player stats"),
    ("reb", "rebounds", "basketball player stats"),
    ("ast", "assists", "basketball player stats"),
    ("gen_gwh", "generation_gwh", "power plant output"),
    ("plant_name", "facility_name", "energy infrastructure"),
)
ABBREVIATION_FIELDS = (
    "customer_id", "first_name", "postal_code", "purchase_amount", "email", "delivery_date", "longitude", "latitude", "field_goals_made", "field_goals_attempted",
    "three_point_made", "rebounds", "assists", "generation_gwh", "facility_name", "last_name", "city", "state", "discount_price", "actual_price", "turnovers",
)
#: The schema of the anomaly benchmark.
SALES_SCHEMA = {
    "product_id": "string", "product_name": "string", "category": "string", "discounted_price": "float", "actual_price": "float", "discount_percentage": "float",
    "rating": "float", "rating_count": "int", "about_product": "string", "user_id": "string", "user_name": "string", "review_id": "string", "review_title": "string",
    "review_content": "string", "img_link": "string", "product_link": "string",
}


def written_names(fields: DataFrame) -> DataFrame:
    """(transform, field, name): every field written in every way, as column expressions.

    A synonym is the smallest of the field's, so that runs repeat; a typo swaps the two letters in a name's middle.
    """
    synonyms = F.create_map(*[F.lit(x) for k, names in FIELD_SYNONYMS.items() for x in (k, min(names))])
    field = F.col("field")
    middle = F.floor(F.length(field) / 2).cast("int")
    swapped = F.concat(F.substring(field, F.lit(1), middle - 1), F.substring(field, middle + 1, F.lit(1)), F.substring(field, middle, F.lit(1)), F.substring(field, middle + 2, F.length(field)))
    ways = {
        "exact": field,
        "case_upper": F.upper(field),
        "case_mixed": F.array_join(F.transform(F.split(field, "_"), lambda part: F.initcap(part)), "_"),
        "synonym": F.coalesce(F.element_at(synonyms, field), field),
        "prefix": F.concat(F.lit(PREFIX), field),
        "suffix": F.concat(field, F.lit(SUFFIX)),
        "fuzzy_typo": F.when(F.length(field) > 3, swapped).otherwise(field),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("transform"), ways[n].alias("name")) for n in TRANSFORM_NAMES]))
    return fields.select("field", rows.alias("w")).select("w.transform", "field", "w.name")


def mapping_benchmark(spark: SparkSession, threshold: float = 0.7, epsilon: float = M.EPSILON, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(transform, tp, fp, fn, ambiguous, precision, recall, f1, ms_per_column) of each way to write the fields' names.

    All names are scored in one plan, then counted by transform.
    """
    truth = written_names(spark.createDataFrame([(f,) for f in fields], "field string"))
    rows = truth.collect()  # a row per field and way
    began = time.perf_counter()
    names = M.names_only(spark, sorted({r.name for r in rows}))
    decided = M.decisions(M.scores(names, M.reference_names(spark, list(fields), M.merged_synonyms(FIELD_SYNONYMS))), names, threshold, epsilon)
    right = F.col("status") == "mapped"
    both = truth.join(decided, truth["name"] == decided["source"])
    counts = both.groupBy("transform").agg(
        F.count_if(right & (F.col("target") == F.col("field"))).alias("tp"), F.count_if(right & (F.col("target") != F.col("field"))).alias("fp"),
        F.count_if(~right).alias("fn"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
    )
    found = counts.collect()
    each = 1000 * (time.perf_counter() - began) / len(rows)
    out = []
    for r in found:
        p, c = (r.tp / (r.tp + r.fp) if r.tp + r.fp else 0.0), (r.tp / (r.tp + r.fn) if r.tp + r.fn else 0.0)
        out.append((r.transform, r.tp, r.fp, r.fn, r.ambiguous, p, c, 2 * p * c / (p + c) if p + c else 0.0, each))
    return spark.createDataFrame(out, "transform string, tp long, fp long, fn long, ambiguous long, precision double, recall double, f1 double, ms_per_column double")


def abbreviation_benchmark(spark: SparkSession, provider: explain.Provider | None = None, threshold: float = 0.6, epsilon: float = 0.08, truth: dict[str, str] | None = None, fields: Sequence[str] = ABBREVIATION_FIELDS) -> DataFrame:
    """(source, truth, status, target, assisted): decisions on abbreviated names, with ties broken by a provider if given."""
    truth = {s: t for s, t, _ in ABBREVIATIONS} if truth is None else truth
    decided = M.map_columns(None, list(truth), list(fields), threshold=threshold, epsilon=epsilon, spark=spark).orderBy("place").collect()
    rows = []
    for r in decided:
        assisted = r.target
        if r.status == "ambiguous":
            assisted = explain.tie(provider, r.source, [c.target for c in r.candidates])
        rows.append((r.source, truth[r.source], r.status, r.target, assisted))
    return spark.createDataFrame(rows, "source string, truth string, status string, target string, assisted string")


def typing_benchmark(df: DataFrame, types: dict[str, str], semantic: dict[str, str]) -> DataFrame:
    """(type_accuracy, precision, recall, f1) on a table of strings as it is."""
    spark = df.sparkSession
    found = spark.createDataFrame(list(inferred(df).items()), "column string, type string")
    schema = E.schema_accuracy(found, spark.createDataFrame(list(types.items()), "column string, type string"))
    scores = E.semantic_scores(semantic_types(df), spark.createDataFrame(list(semantic.items()), "column string, semantic_type string"))
    return schema.select(F.col("accuracy").alias("type_accuracy")).crossJoin(F.broadcast(scores.select("precision", "recall", "f1")))  # one row each


def anomaly_benchmark(spark: SparkSession, rows: int = 1000, contamination: float = 0.05, clean: DataFrame | None = None, keys: Sequence[str] = ("key",)) -> DataFrame:
    """(scenario, tp, fp, fn, precision, recall, f1) of z-score, interquartile range and forest together on variants of a
    table, or of made sales."""
    keys = list(keys)
    clean = D.base_rows(spark, {"key": "key", **SALES_SCHEMA}, rows) if clean is None else clean
    clean = stored(spread(clean))  # all scenarios read it many times
    out = None
    for name, plan in D.SCENARIOS.items():
        variant, truth = D.scenario(clean, keys, plan, name)
        variant = stored(spread(variant))  # it is read many times
        names = numeric_columns(variant, exclude=keys)
        forest = isolation_forest(variant, names, contamination) if len(names) > 1 else None
        found = A.union_of_rows(variant, keys, forest=forest).select(D.key_text(keys).alias("row"))
        part = E.row_scores(found, truth).withColumn("scenario", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def folder_diffs(spark: SparkSession, folder: str, out: str, max_rows: int | None = 1000) -> dict[str, dict]:
    """Schemas of a folder's CSV files, and what each changes against the first; written as reports below ``out``."""
    schemas = {n: cleaned_schema(read_csv(spark, os.path.join(folder, n), max_rows)) for n in csv_files(spark, folder)}
    names = list(schemas)
    changes = {}
    for n in names:
        write_schema_report(schemas[n], os.path.join(out, f"{n}.schema.json"))
        if n != names[0]:
            changes[n] = diff_of(schemas[names[0]], schemas[n])
            write_text(diff_text(changes[n]), os.path.join(out, f"{n}.diff.txt"))
    return changes


def generated(spark: SparkSession, schemas: dict[str, dict[str, str]], out: str, rows: int = 1000, scenarios: Sequence[str] | None = None, kind: str = "csv", truth_only: bool = False) -> list[str]:
    """Made tables of each schema, clean and by scenario, with their truths, below ``out``; names of the variants."""
    done = []
    plans = {n: D.SCENARIOS[n] for n in scenarios or D.SCENARIOS}
    for name, schema in schemas.items():
        clean = D.base_rows(spark, {"row_key": "key", **schema}, rows)
        if not truth_only:
            write(clean, f"{out}/{name}", kind)
        done += [f"{name}_{s}" for s in variants(clean, name, ["row_key"], out, kind, plans, truth_only)]
    return done
