"""Variants of tables by scenario, their truth, and the end-to-end score of the engine against it."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import numeric_columns
from ..operators import anomalies as A
from ..operators import degrade as D
from ..operators import evaluate as E
from ..operators import mapping as M
from ..operators.forest import isolation_forest
from ..operators.profile import schema_of
from ..operators.refine import inferred, refined, schema_word
from ..operators.schemas import schema_frame
from ..operators.semantic import semantic_types
from ..sources.files import spread, stored
from ..sources.sinks import write, write_json_report


def ground_truth(df: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Types and semantic types of the clean table."""
    clean = refined(df)
    return schema_of(clean), {r.column: r.semantic_type for r in semantic_types(clean).collect()}


def generator_schema(types: dict[str, str]) -> dict[str, str]:
    """A catalog's types as the generator's words."""
    return {n: schema_word(t) for n, t in types.items()}


def variants(df: DataFrame, table: str, keys: list[str], out: str | None = None, kind: str = "parquet", scenarios: dict[str, D.Scenario] | None = None, truth_only: bool = False) -> dict[str, tuple[DataFrame, DataFrame, D.TruthRecord]]:
    """(variant, truth, record) by scenario; written below ``out`` as {table}_{scenario}, {table}_{scenario}_truth
    and, the record, {table}_{scenario}_truth.json."""
    types, semantic = ground_truth(df)
    rows, made = df.count(), {}
    for name, plan in (scenarios or D.SCENARIOS).items():
        variant, truth = D.scenario(df, keys, plan, name)
        shares = {k: v for k, v in asdict(plan).items() if v}
        changed = {k: {"share": v, "rows": int(rows * v)} for k, v in shares.items()}
        record = D.TruthRecord(table, name, datetime.now(UTC).isoformat(timespec="seconds"), rows, df.columns, types, semantic, shares, changed)
        if out:
            if not truth_only:
                write(variant, f"{out}/{table}_{name}", kind)
            write(truth, f"{out}/{table}_{name}_truth", "parquet")
            text = df.sparkSession.createDataFrame([(json.dumps(asdict(record), ensure_ascii=False),)], "value string")
            text.coalesce(1).write.mode("overwrite").text(f"{out}/{table}_{name}_truth.json")
        made[name] = (variant, truth, record)
    return made


def scored(variant: DataFrame, truth: DataFrame, record: D.TruthRecord, keys: list[str], contamination: float = 0.05) -> dict:
    """The four metrics of one variant; all five detectors together find its rows."""
    spark: SparkSession = variant.sparkSession
    work = refined(variant, inferred(variant.drop(*keys)))
    names = [n for n in numeric_columns(work) if n not in keys]
    flagged = A.flags(work, 3.0, True, True, None, names).withColumn("_m", A.missing_count(work) >= 1)
    hit = flagged.where("size(flags.zscore) > 0 OR size(flags.iqr) > 0 OR flags.categorical OR _m").select(D.key_text(keys).alias("row"))
    if len(names) > 1:
        hit = hit.unionByName(isolation_forest(work, names, contamination).select(D.key_text(keys).alias("row")))
    anomaly = E.row_scores(hit, truth).first()
    types = spark.createDataFrame(list(record.original_schema.items()), "column string, type string")
    schema = E.schema_accuracy(schema_frame(work), types).first()
    found = semantic_types(work)
    wanted = spark.createDataFrame(list(record.expected_semantic_types.items()), "column string, semantic_type string")
    semantic = E.semantic_scores(found, wanted).first()
    identity = spark.createDataFrame([(c, c) for c in record.columns], "source string, target string")
    mapped = E.mapping_accuracy(M.map_columns(work, None, record.columns, threshold=0.7, epsilon=0.05), identity).first()
    return {"table": record.original_table, "scenario": record.quality_level, "anomaly_f1": anomaly.f1, "schema_accuracy": schema.accuracy, "semantic_f1": semantic.f1, "mapping_accuracy": mapped.accuracy}


def end_to_end(tables: dict[str, tuple[DataFrame, list[str]]], out: str | None = None, report: str | None = None) -> DataFrame:
    """(table, scenario, metrics) of every table and scenario; also as a JSON file ``report`` of the driver, if given."""
    results = []
    spark = None
    for name, (df, keys) in tables.items():
        spark = df.sparkSession
        for variant, truth, record in variants(df, name, keys, out).values():
            results.append(scored(stored(spread(variant)), truth, record, keys))  # it is read many times
    if report:
        write_json_report({"results": results}, report)
    return spark.createDataFrame(results, "table string, scenario string, anomaly_f1 double, schema_accuracy double, semantic_f1 double, mapping_accuracy double")
