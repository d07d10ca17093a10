"""Comparison of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean


def schema_frame(df: DataFrame) -> DataFrame:
    """(column, type) of a table."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")


def cleaned_schema(df: DataFrame) -> dict[str, str]:
    """Types by cleaned name; of names that become equal, the last stays."""
    rows = schema_frame(df).select(clean(F.col("column")).alias("name"), "type").collect()  # a row per column
    return {r.name: r.type for r in rows}


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, change, old, new) of two (column, type) frames; change is added, removed or changed."""
    rows = old.withColumnRenamed("type", "old").join(new.withColumnRenamed("type", "new"), "column", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return rows.select("column", change.alias("change"), "old", "new").where("change IS NOT NULL")


def diff_of(old: dict[str, str], new: dict[str, str]) -> dict:
    """The same of two dicts: added, removed, and changed with old and new."""
    both = old.keys() & new.keys()
    return {
        "added": {k: v for k, v in new.items() if k not in old},
        "removed": {k: v for k, v in old.items() if k not in new},
        "changed": {k: {"old": old[k], "new": new[k]} for k in old if k in both and old[k] != new[k]},
    }


#: The report's titles and its line for equal schemas, and those of the printed form.
REPORT_TITLES = {"added": "HINZUGEFÜGTE FELDER:", "removed": "ENTFERNTE FELDER:", "changed": "GEÄNDERTE FELDER:"}
REPORT_EQUAL = "Keine Änderungen festgestellt."
PRINTED_TITLES = {"added": "Hinzugefügt", "removed": "Entfernt", "changed": "Geändert"}
PRINTED_HEAD, PRINTED_EQUAL = "Schemaänderungen:", "Keine Änderungen vorhanden."


def diff_text(changes: dict) -> str:
    """A report with a section for each kind of change that there is."""
    parts = []
    for kind, title in REPORT_TITLES.items():
        if entries := changes.get(kind):
            lines = (f"  {k}: {v['old']} -> {v['new']}" if isinstance(v, dict) else f"  {k}: {v}" for k, v in entries.items())
            parts.append("\n".join([title, *lines]))
    return ("\n\n".join(parts) or REPORT_EQUAL) + "\n"


def diff_summary(changes: dict) -> str:
    """One line for each kind of change."""
    lines = [f"  {title}: {changes[kind]}" for kind, title in PRINTED_TITLES.items() if changes.get(kind)]
    return "\n".join([PRINTED_HEAD, *(lines or [f"  {PRINTED_EQUAL}"])])
