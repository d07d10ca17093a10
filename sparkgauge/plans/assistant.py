"""Whole runs: every table of a source refined, profiled, typed, mapped and searched for anomalies, as one report.

Tables stay lazy; only bounded results come to the driver: profiles, names, counts, previews of five rows, and the row
indexes of flagged rows, which ``max_listed_rows`` bounds if given.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import ROW_INDEX, numeric_columns, q, with_row_index
from ..operators import anomalies as A
from ..operators import mapping as M
from ..operators import profile as P
from ..operators.forest import isolation_forest
from ..operators.refine import refined
from ..operators.semantic import semantic_types
from ..sources.catalog import SqlSource
from ..sources.files import Dataset, LocalFiles, stored
from ..sources.sinks import ANOMALY_ROWS, ReportStore, save_sample, write
from . import explain
from .config import AnomalyConfig, MappingConfig, SourceConfig

log = logging.getLogger(__name__)
PREVIEW_ROWS = 5
#: Methods whose rows are saved as samples; steps of progress.
SAVED = ("isolation_forest", "categorical", "missing_values")
STEPS = {"start": 5, "refined": 10, "profiled": 30, "typed": 50, "mapped": 70, "anomalies": 75, "done": 80}
Progress = Callable[[int, str], None]


def _plain(v):
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return float(v) if isinstance(v, Decimal) else v


def _rows(df: DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


#: Flagged row indexes that a report lists at most unless told otherwise; counts are of all, and so are the tables of ``flagged_rows``.
LISTED_ROWS = 10_000


def _listed(df: DataFrame, most: int) -> list[int]:
    """The first ``most`` flagged row indexes, by a top-k that no task or driver outgrows."""
    return [r[0] for r in df.select(ROW_INDEX).orderBy(ROW_INDEX).limit(most).collect()]


@dataclass(frozen=True)
class Flagged:
    """Flagged rows: a table (row index, column, method), where ``column`` is null for methods that judge whole rows, and counts."""

    rows: DataFrame
    errors: dict[str, str]


def flagged_rows(df: DataFrame, config: AnomalyConfig, survey: P.Survey | None = None, known: tuple[int, DataFrame] | None = None) -> Flagged:
    """All flagged rows of ``df``, which has the row index, as a stored table.

    Detectors but the forest share one scan; a survey of the table and counts of its values, where given, save the scans for their bounds.
    """
    names = numeric_columns(df)
    data = df.drop(ROW_INDEX).columns
    found = df.sparkSession.createDataFrame([], f"{ROW_INDEX} long, column string, method string")
    errors: dict[str, str] = {}
    if config.numeric_gate and not names:
        return Flagged(found, errors)
    z_bounds = A.bounds_of({n: survey.moments[n] for n in names}, config.z_threshold) if survey else None
    rare = A.rare_values(df, known=known) if config.use_categorical and known else None
    flagged = A.flags(df, config.z_threshold if config.use_zscore and names else None, config.use_iqr and bool(names), config.use_categorical, None, names, z_bounds, rare)
    which = flagged.schema["flags"].dataType.names

    def by_column(method: str) -> Column:
        return F.transform(f"flags.{method}", lambda n: F.struct(n.alias("column"), F.lit(method).alias("method")))

    hits = [by_column(m) for m in ("zscore", "iqr") if m in which]
    whole = [("categorical", F.col("flags.categorical"))] * config.use_categorical + [("missing_values", A.missing_count(df, data) >= config.missing_threshold)] * config.use_missing
    hits += [F.when(test, F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(m).alias("method")))).otherwise(F.array().cast("array<struct<column:string,method:string>>")) for m, test in whole]
    if hits:
        found = flagged.select(ROW_INDEX, F.explode(F.concat(*hits)).alias("x")).select(ROW_INDEX, "x.column", "x.method")
    found = stored(found)
    if config.use_isolation_forest and names:
        try:
            forest = isolation_forest(df.select(ROW_INDEX, *[q(n) for n in names]), names, config.contamination, config.n_estimators, config.random_state)
            found = found.unionByName(stored(forest.select(ROW_INDEX, F.lit(None).cast("string").alias("column"), F.lit("isolation_forest").alias("method"))))
        except Exception as e:  # noqa: BLE001 the other detectors' results stay, and the report tells the error
            errors["isolation_forest"] = str(e)[:2000]
    return Flagged(found, errors)


def find_anomalies(
    df: DataFrame, name: str, config: AnomalyConfig, save_dir: str | None = None, max_listed_rows: int = LISTED_ROWS, survey: P.Survey | None = None, known: tuple[int, DataFrame] | None = None,
) -> dict:
    """Counts, rows, previews and saved samples by method. ``df`` has the row index.

    Counts of z-score and interquartile range are sums over columns, their rows distinct, their previews those of the first column
    that has any. With ``save_dir`` the table of all flagged rows is written beside the samples. An error of the forest
    stands in ``anomaly_errors``, with 0 as its count.
    """
    out: dict = {"anomalies": {}, "anomaly_rows": {}, "anomaly_previews": {}, "anomaly_samples_saved": {}}
    names = numeric_columns(df)
    if config.numeric_gate and not names:
        return out
    flagged = flagged_rows(df, config, survey, known)
    counts = {(r.method, r.column): r.n for r in flagged.rows.groupBy("method", "column").agg(F.count("*").alias("n")).collect()}  # a row for each method and column
    shown: dict[str, tuple[list[int], list[int]]] = {}
    for m, used in (("zscore", config.use_zscore and names), ("iqr", config.use_iqr and names), ("isolation_forest", config.use_isolation_forest and names), ("categorical", config.use_categorical), ("missing_values", config.use_missing)):
        count = sum(n for (method, _), n in counts.items() if method == m)
        if not used or (m in ("categorical", "missing_values") and not count):
            continue
        out["anomalies"][m] = count
        if m in flagged.errors:
            out.setdefault("anomaly_errors", {})[m] = flagged.errors[m]
            continue
        out["anomaly_rows"][m], out["anomaly_previews"][m], out["anomaly_samples_saved"][m] = [], [], None
        if count:
            rows = flagged.rows.where(F.col("method") == m)
            out["anomaly_rows"][m] = _listed(rows.select(ROW_INDEX).distinct(), max(max_listed_rows, ANOMALY_ROWS))
            first = next((n for n in names if (m, n) in counts), None)
            seen = out["anomaly_rows"][m] if first is None else _listed(rows.where(F.col("column") == first), PREVIEW_ROWS)
            shown[m] = seen[:PREVIEW_ROWS], out["anomaly_rows"][m][:ANOMALY_ROWS] if save_dir and m in SAVED else []
            out["anomaly_rows"][m] = out["anomaly_rows"][m][:max_listed_rows]
    wanted = sorted({i for a, b in shown.values() for i in (*a, *b)})  # ANOMALY_ROWS a method at most
    rows = {r[ROW_INDEX]: r for r in df.where(q(ROW_INDEX).isin(wanted)).collect()} if wanted else {}
    for m, (seen, saved) in shown.items():
        extra = {"is_anomaly": True} if m == "isolation_forest" else {}
        out["anomaly_previews"][m] = [{k: _plain(v) for k, v in rows[i].asDict(recursive=True).items() if k != ROW_INDEX} | extra for i in seen]
        if saved:
            sample = df.sparkSession.createDataFrame([rows[i] for i in saved], df.schema).withColumns({k: F.lit(v) for k, v in extra.items()})
            out["anomaly_samples_saved"][m] = save_sample(sample, save_dir, name, m, [ROW_INDEX])
    if save_dir and counts:
        safe = name.replace("/", "__")
        out["anomaly_rows_saved"] = f"{save_dir.rstrip('/')}/{safe}/{safe}__flagged.parquet"
        write(flagged.rows, out["anomaly_rows_saved"], "parquet")
    return out


def _tagged(found: dict) -> list[dict]:
    """Two previews of each method, five together."""
    rows: list[dict] = []
    for method, shown in found["anomaly_previews"].items():
        if len(rows) >= explain.ANOMALIES:
            break
        rows += [r | {"_flagged_by": method} for r in shown[:2]]
    return rows[: explain.ANOMALIES]


def analyze_table(
    dataset: Dataset, anomalies: AnomalyConfig | None = None, mapping: MappingConfig | None = None, save_dir: str | None = None,
    provider: explain.Provider | None = None, progress: Progress | None = None, max_listed_rows: int = LISTED_ROWS,
) -> dict:
    """The report of one dataset."""
    tell = progress or (lambda percent, step: None)
    anomalies, mapping = anomalies or AnomalyConfig(), mapping or MappingConfig()
    tell(STEPS["start"], "start")
    df = refined(dataset.df)
    tell(STEPS["refined"], "refined")
    indexed = with_row_index(df)
    seen = P.survey(df)
    rows, ratios, numbers = seen.rows, seen.missing, seen.numbers
    few = A.few_valued(seen.distinct, max(A.MAX_DISTINCT, P.CATEGORY_VALUES))
    known = (rows, stored(A.frequencies(df, few)) if few else None)  # values of columns that have few
    texts: dict[str, dict] = {}
    for r in P.text_stats(indexed, [ROW_INDEX]).orderBy("column", "rank").collect():
        texts.setdefault(r.column, {"unique_count": r.unique_count, "top_values": []})["top_values"].append({"value": r.value, "count": r["count"]})
    categories = sorted(r.column for r in P.categorical_columns(df, known).collect()) if few else []
    tell(STEPS["profiled"], "profiled")
    detected = {r.column: r.semantic_type for r in semantic_types(indexed, [ROW_INDEX]).collect()}
    tell(STEPS["typed"], "typed")
    insights = {"descriptions": {}, "summary": None, "anomaly_explanation": None}
    if provider is not None:
        for c in df.columns:
            if c not in detected:
                insights["descriptions"][c] = explain.column(provider, c, [_plain(r[0]) for r in indexed.orderBy(ROW_INDEX).select(q(c)).limit(explain.COLUMN_VALUES).collect()])
        insights["summary"] = explain.table(provider, dataset.name, df.columns, _rows(indexed.orderBy(ROW_INDEX).drop(ROW_INDEX).limit(explain.TABLE_ROWS)))
    decided = []
    if mapping.references:
        decided = M.map_columns(df, None, mapping.references, mapping.synonyms, mapping.threshold, mapping.epsilon, mapping.force, detected=detected).orderBy("place").collect()  # a row per column
    unmapped = [r.source for r in decided if r.status == "unmapped"] if mapping.references else list(df.columns)
    tell(STEPS["mapped"], "mapped")
    found = find_anomalies(indexed, dataset.name, anomalies, save_dir, max_listed_rows, seen, known)
    tell(STEPS["anomalies"], "anomalies")
    if provider is not None:
        insights["anomaly_explanation"] = explain.anomalies(provider, dataset.name, _tagged(found))
    report = {
        "name": dataset.name, "path": dataset.path, "rows": rows, "cols": len(df.columns), "schema": P.schema_of(df), "semantic_types": detected,
        "statistics": {"missing_ratios": ratios, "numeric_stats": numbers, "text_stats": texts, "row_count": rows, "col_count": len(df.columns)},
        "nested_structures": P.nested_columns(df), "categorical_cols": categories, "llm_insights": insights,
        "mapping": {r.source: {"target": r.target, "score": r.score, "reason": r.reason.asDict()} for r in decided if r.status == "mapped"},
        "ambiguous": {r.source: [c.asDict() for c in r.candidates] for r in decided if r.status == "ambiguous"},
        "unmapped": unmapped, **found,
    }
    tell(STEPS["done"], "done")
    return report


def source_of(spark: SparkSession, config: SourceConfig):
    if config.type == "local":
        return LocalFiles(spark, config.root, config.max_rows)
    return SqlSource(spark, config.query, config.schema, config.max_rows)


def analyze(source, anomalies: AnomalyConfig | None = None, mapping: MappingConfig | None = None, save_dir: str | None = None, provider: explain.Provider | None = None, progress: Progress | None = None, max_listed_rows: int = LISTED_ROWS) -> dict:
    """The report of all datasets of a source. Each table's references are the given ones and the columns of the others."""
    mapping = mapping or MappingConfig()
    datasets = list(source.datasets())  # lazy tables
    columns = {d.name: d.df.columns for d in datasets}
    reports = []
    for d in datasets:
        references = tuple(M.dynamic_references(columns, d.name, mapping.references))
        own = MappingConfig(references, mapping.synonyms, mapping.threshold, mapping.epsilon, mapping.force)
        reports.append(analyze_table(d, anomalies, own, save_dir, provider, progress, max_listed_rows))
    return {"data_root": getattr(source, "root", None), "datasets": reports}


def run(spark: SparkSession, source: SourceConfig, store: ReportStore | None = None, run_id: str | None = None, **settings) -> tuple[str | None, dict]:
    """A run that the store keeps, under a new id unless given: (its id, the report). The log has its begin and end."""
    if store and run_id is None:
        run_id = store.put()
    log.info(json.dumps({"run": run_id, "event": "start", "source": source.type}))
    try:
        report = analyze(source_of(spark, source), **settings)
    except Exception as e:
        log.error(json.dumps({"run": run_id, "event": "error", "error": type(e).__name__, "message": str(e)}))
        if store:
            store.put(run_id, "error", error=str(e))
        raise
    if store:
        store.put(run_id, "complete", report)
    log.info(json.dumps({"run": run_id, "event": "complete", "datasets": len(report["datasets"])}))
    return run_id, report


def run_async(spark: SparkSession, source: SourceConfig, store: ReportStore, **settings) -> tuple[str, threading.Thread]:
    """(id, thread) of a run that goes on by itself; the store has it as queued, then as complete or error."""
    run_id = store.put()

    def work() -> None:
        try:
            run(spark, source, store, run_id, **settings)
        except Exception:  # noqa: BLE001 the store and the log have it
            pass

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    return run_id, thread


def run_stream(spark: SparkSession, source: SourceConfig, store: ReportStore | None = None, **settings) -> Iterator[dict]:
    """Events of a run: progress, then complete with the report, or error."""
    events: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            run_id, report = run(spark, source, store, progress=lambda p, s: events.put({"event": "progress", "percent": p, "step": s}), **settings)
            events.put({"event": "complete", "id": run_id, "report": report})
        except Exception as e:  # noqa: BLE001 the event tells it
            events.put({"event": "error", "message": str(e)})

    threading.Thread(target=work, daemon=True).start()
    while True:
        event = events.get()
        yield event
        if event["event"] != "progress":
            return
