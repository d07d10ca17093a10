import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
FEW = ("anomaly_zscore_events", "anomaly_iqr_events", "anomaly_rare_category", "degrade_missing", "profile_numeric_stats", "normalize_names", "schema_diff", "sql_passthrough_join", "mapping_decisions", "semantic_types_made", "analyze_anomalies", "sink_formats")


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(str(plain(v)) for v in r) for r in cur.fetchall())
    assert sorted(tuple(str(plain(r[n])) for n in names) for r in df.collect()) == want
