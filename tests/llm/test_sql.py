"""The operators' SQL against the operators, on the test tables and on odd ones."""

import os

import duckdb
import pytest

import corpus_pipeline
from sparkgauge.llm import decontam, linededup, neardup, registry

SF = "/root/testdata/sf0.001"
LINE = "one two three four five six"
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"),
    (7, f"{LINE}\n{LINE} a\n{LINE} b\n\nmine alone"), (8, f"head\n{LINE}\n{LINE} a\n{LINE} b"), (9, f"{LINE}\n{LINE} a\n{LINE} b"),
    (10, f"{LINE}\n{LINE} a\n{LINE} b\n\n{LINE}\n{LINE} a\n{LINE} b\nend"), (11, " ".join(map(str, range(25))) + "\nx"), (12, "y\n" + " ".join(map(str, range(25)))),
    (13, "the capital of the land of plenty is the city of gold"), (14, "Say: THE capital of the land of plenty, is the city of gold!"), (15, "who knows"), (16, "they said who knows and went"),
]
ITEMS = [(1, "The capital of the land of plenty is the city of gold"), (2, "who knows"), (3, None), (4, "..."), (5, "one")]


def rows_of(cur):
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def compared(df, cur):
    names, want = rows_of(cur)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == want
    return want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op6_decontam", "op7_neardup", "op9_linededup", "pipeline"])
def test_whole_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    query, sql = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL) if name == "pipeline" else (registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert compared(query(spark, SF), con.execute(sql))


def test_odd_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", ROWS)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    docs, items = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")

    lines = compared(linededup.deduped(docs).select("d.doc_id", "text", "n_removed"), con.execute("WITH " + linededup.SQL + " SELECT doc_id, text, n_removed FROM l_done"))
    assert sum(r[1] > 0 for r in lines) == 4  # documents 8, 9, 10 and 12
    groups = neardup.grouped(docs, k=2).selectExpr("k AS doc_id", "n AS n_shingles", "root AS component_id")
    found = compared(groups, con.execute("WITH RECURSIVE " + neardup.SQL + " SELECT doc_id, n_shingles, component_id FROM n_grouped"))
    assert (4, 5, 1) in found
    leaks = decontam.leaked(docs, items).selectExpr("doc_id", "item_id", "round(score, 6) AS score", "question_overlap", "answer_overlap")
    found = compared(leaks, con.execute("WITH " + decontam.SQL + " SELECT * FROM d_leaks"))
    assert {r[1:3] for r in found} == {(4, 5), (5, 5), (13, 1), (14, 1), (15, 2), (16, 2)}
