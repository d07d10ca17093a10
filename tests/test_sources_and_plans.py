import json
import os

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import degrade as D
from sparkgauge.operators import evaluate as E
from sparkgauge.plans import explain
from sparkgauge.functions.types import with_row_index
from sparkgauge.plans.assistant import analyze, analyze_table, run, run_async, run_stream, find_anomalies
from sparkgauge.plans.cli import main, settings
from sparkgauge.plans.config import AnomalyConfig, MappingConfig, SourceConfig
from sparkgauge.plans.variants import variants
from sparkgauge.sources import catalog as C
from sparkgauge.sources import sinks as K
from sparkgauge.sources.files import Dataset, LocalFiles, csv_files, read_file, read_csv, rejects


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("col1,col2\n" + "".join(f"{i},x{i}\n" for i in range(300)))
    (tmp_path / "bad.csv").write_text("col1,col2\n1,2\n3\n")
    (tmp_path / "sub" / "b.json").write_text('[{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]')
    (tmp_path / "sub" / "c.jsonl").write_text('{"k": 1}\n{"k": 2}\n{"k": 3}\n')
    (tmp_path / "broken.parquet").write_text("no parquet")
    (tmp_path / "note.txt").write_text("x")
    return str(tmp_path)


def test_local_files(spark, folder):
    data = {d.name: d for d in LocalFiles(spark, folder).datasets()}
    assert list(data) == ["a.csv", "bad.csv", "broken.parquet (read_error)", "sub/b.json", "sub/c.jsonl"]
    assert data["a.csv"].df.count() == 300 and data["a.csv"].df.dtypes == [("col1", "int"), ("col2", "string")]
    assert data["bad.csv"].df.count() >= 2
    assert data["sub/b.json"].df.count() == 2 and data["sub/c.jsonl"].df.count() == 3
    assert data["broken.parquet (read_error)"].df.columns == ["_error", "_path"]
    assert [d.df.count() for d in LocalFiles(spark, folder, 2).datasets()][:1] == [2]
    assert csv_files(spark, folder) == ["a.csv", "bad.csv"]
    with pytest.raises(ValueError):
        read_file(spark, folder + "/note.txt")


def test_csv_empties_are_null(spark, tmp_path):
    (tmp_path / "e.csv").write_text('a,b\n1,""\n2,\n3,x\n')
    df = read_file(spark, str(tmp_path / "e.csv"))
    assert df.where("b IS NULL").count() == 2


def test_sql_source(spark):
    (one,) = C.SqlSource(spark, "SELECT 1 AS a, 3 AS b UNION ALL SELECT 2, 4;").datasets()
    assert one.name == "sql_query" and one.df.count() == 2
    (bad,) = C.SqlSource(spark, "SELECT nope FROM nowhere").datasets()
    assert "error" in bad.name and bad.df.columns == ["_error"]
    assert C.query(spark, "SELECT id FROM (SELECT * FROM range(9) LIMIT 5)", 3).count() == 3
    with pytest.raises(ValueError):
        C.SqlSource(spark, " ", "")
    (lost,) = C.SqlSource(spark, schema="no_such_schema").datasets()
    assert "discovery_error" in lost.name


def test_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    for n in ("table1", "table2", "table1_quality_low", "table1_quality_quality", "table1_truth"):
        spark.createDataFrame([(1, "a"), (2, "b")], "col1 long, col2 string").write.mode("overwrite").saveAsTable(f"shop.{n}")
    assert [(d.name, d.df.count()) for d in C.SqlSource(spark, schema="shop").datasets()][:2] == [("shop.table1", 2), ("shop.table1_quality_low", 2)]
    assert C.source_tables(spark, "shop") == ["table1", "table2"] and "shop" in C.schemas(spark) and C.tables(spark, "nothing") == []
    assert C.table_schema(spark, "shop.table1") == {"col1": "bigint", "col2": "string"}
    assert C.drop_nested_variants(spark, "shop") == ["table1_quality_quality"]
    K.write(spark.table("shop.table1"), str(tmp_path / "p"), "parquet")
    C.promote(spark, "shop.promoted", str(tmp_path / "p"))
    C.promote(spark, "shop.promoted", str(tmp_path / "p"))
    C.refresh(spark, "shop.promoted")
    assert spark.table("shop.promoted").count() == 2
    assert len(K.export_samples(spark, ["shop.table2"], str(tmp_path / "x"))) == 1
    spark.sql("DROP DATABASE shop CASCADE")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "NaN"), ("2", "x")], "a string, b string")
    for kind in ("csv", "json", "parquet", "delta"):
        K.write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "delta")).where("b IS NULL").count() == 1
    with pytest.raises(ValueError):
        K.write(df, "x", "xml")
    results = spark.createDataFrame([("t_1", "low", 0.5, 1.0, None, 0.25)], "table string, scenario string, anomaly_f1 double, schema_accuracy double, semantic_f1 double, mapping_accuracy double")
    assert r"t\_1 & low & 50.00\% & 100.00\% & -- & 25.00\%" in K.latex_tables(results)


def people(spark):
    rows = [(i, float(i % 10), "common" if i % 50 else None, f"u{i}@x.org") for i in range(200)] + [(200, 1e6, "rare", "z@x.org")]
    return spark.createDataFrame(rows, "id long, amount double, kind string, mail string")


def test_analyze_table(spark, tmp_path):
    steps = []
    report = analyze_table(Dataset("people", None, people(spark)), AnomalyConfig(n_estimators=10), MappingConfig(("email", "amount")), str(tmp_path), lambda p: "prose", lambda p, s: steps.append(p))
    assert report["rows"] == 201 and report["cols"] == 4 and report["semantic_types"] == {"mail": "Email"}
    assert report["mapping"]["mail"]["target"] == "email" and report["mapping"]["amount"]["target"] == "amount"
    assert report["anomalies"]["zscore"] == 1 and report["anomaly_rows"]["zscore"] == [200]
    assert report["anomaly_rows"]["categorical"] == [200] and report["anomalies"]["missing_values"] == 4
    assert report["anomaly_previews"]["zscore"][0]["amount"] == 1e6 and os.path.exists(report["anomaly_samples_saved"]["missing_values"])
    assert report["llm_insights"]["summary"] == "prose" and steps == sorted(steps) and steps[-1] == 80
    json.dumps(report)


def test_gate(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("",)], "s string")
    d = Dataset("t", None, df)
    assert analyze_table(d)["anomalies"] == {"missing_values": 1}
    assert analyze_table(d, AnomalyConfig(numeric_gate=True))["anomalies"] == {}


def test_runs(spark, folder, tmp_path):
    store = K.ReportStore(str(tmp_path / "runs"))
    config = SourceConfig("local", folder)
    fast = AnomalyConfig(use_isolation_forest=False)
    run_id, report = run(spark, config, store, anomalies=fast)
    assert store.index()[run_id]["status"] == "complete" and store.report(run_id)["datasets"][0]["name"] == "a.csv" and store.report("x") is None
    assert K.totals(report)["rows"] > 300 and "a.csv" in K.summary(report) and store.artifacts(run_id) == []
    events = list(run_stream(spark, SourceConfig("sql", query="SELECT 1 AS a"), anomalies=fast))
    assert events[-1]["event"] == "complete" and events[0]["event"] == "progress"
    assert list(run_stream(spark, SourceConfig("local", "/no/such/folder"), store))[-1]["event"] == "error"


def test_dynamic_references(spark):
    class Two:
        def datasets(self):
            return iter([Dataset("a", None, spark.range(3).selectExpr("id AS email_address")), Dataset("b", None, spark.range(3).selectExpr("id AS email"))])

    report = analyze(Two(), AnomalyConfig(use_isolation_forest=False))
    assert report["datasets"][0]["mapping"]["email_address"]["target"] == "email"


def test_cli(spark, folder, tmp_path, capsys):
    assert main(["--sql"]) == 1
    out = tmp_path / "r.json"
    assert main(["--sql", "--query", "SELECT id, id * 2.0D AS x FROM range(20)", "--zscore", "--output", str(out)]) == 0
    assert json.loads(out.read_text())["datasets"][0]["anomalies"] == {"zscore": 0}
    (tmp_path / "c.yml").write_text("threshold: 0.9\nreferences: [a, b]\n")
    args = settings(["--config", str(tmp_path / "c.yml"), "--threshold", "0.1", "--references", "x,y"])
    assert args.threshold == 0.9 and args.references == ["x", "y"]


def test_bounds():
    for bad in (lambda: AnomalyConfig(contamination=0.5), lambda: MappingConfig(threshold=1.1), lambda: SourceConfig("ftp"), lambda: SourceConfig("local"), lambda: SourceConfig("sql")):
        with pytest.raises(ValueError):
            bad()


def test_tie():
    assert explain.tie(lambda p: "I say: zip\nphone", "z", ["phone", "zip"]) == "zip" and explain.tie(None, "z", ["a"]) is None
    assert explain.column(lambda p: 1 / 0, "c", []) is None


def test_scenarios(spark):
    df = people(spark)
    out, truth = D.scenario(df, ["id"], D.SCENARIOS["medium_quality"])
    counts = {r.issue: r.n for r in truth.groupBy("issue").agg(F.count_distinct("row").alias("n")).collect()}
    assert counts == {"missing": 20, "invalid": 10, "duplicates": 10} and out.count() == 211
    again = D.scenario(df, ["id"], D.SCENARIOS["medium_quality"])[0]
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    assert D.base_rows(spark, {"a": "int", "b": "float", "c": "string", "d": "datetime", "e": "x"}, 50).count() == 50
    assert D.outliers(df.select("id", "kind"), ["id"], 0.1)[1].count() == 0


NULLS = ("id", "if(id % 2 = 0, id, null) AS a", "if(id % 3 = 0, int(-id), null) AS b", "if(id % 5 = 0, id / 4, null) AS c")


def test_outliers_leave_nulls_in_variants(spark, tmp_path):
    df = spark.range(40).selectExpr(*NULLS)
    variants(df, "t", ["id"], str(tmp_path), scenarios={"x": D.Scenario(outliers=1.0)})
    out = spark.read.parquet(str(tmp_path / "t_x"))
    assert sorted(map(tuple, out.collect())) == [(r.id, *[None if v is None else v * 5 for v in (r.a, r.b, r.c)]) for r in df.collect()]


def test_scenario_leaves_missing_values_missing(spark):
    out = D.scenario(spark.range(40).selectExpr(*NULLS), ["id"], D.Scenario(missing=1.0, outliers=1.0))[0]
    assert sorted(map(tuple, out.collect())) == [(i, None, None, None) for i in range(40)]


def test_evaluation(spark):
    rows = lambda x: spark.createDataFrame([(i,) for i in x], "row string")
    r = E.row_scores(rows("aabc"), rows("bcd")).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.precision == pytest.approx(2 / 3)
    assert E.row_scores(rows(""), rows("")).first().f1 == 0.0
    none = spark.createDataFrame([], "column string, semantic_type string")
    assert E.semantic_scores(none, none).first().f1 == 1.0
    assert E.schema_accuracy(spark.createDataFrame([], "column string, type string"), spark.createDataFrame([], "column string, type string")).first().accuracy is None


def test_streams(spark, tmp_path):
    from sparkgauge.streaming.detectors import missing_stream, zscore_stream

    history = spark.createDataFrame([(float(i % 5), "a") for i in range(100)], "x double, s string")
    spark.createDataFrame([(1.0, "a"), (500.0, "b"), (2.0, "")], "x double, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, s string").parquet(str(tmp_path / "in"))
    for name, df, want in (("z", zscore_stream(stream, history, ["x"]), [500.0]), ("m", missing_stream(stream), [2.0])):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert [r.x for r in spark.table(name).collect()] == want


def test_runs_put_at_once_are_all_in_the_index(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from sparkgauge.sources.sinks import ReportStore

    with ThreadPoolExecutor(8) as pool:
        runs = set(pool.map(lambda i: ReportStore(str(tmp_path)).put(status="complete", report={"datasets": [], "n": i}), range(60)))
    assert set(ReportStore(str(tmp_path)).index()) == runs and len(runs) == 60


def test_tables_are_found_by_name_and_by_path(spark, tmp_path):
    spark.sql(f"CREATE DATABASE lookup LOCATION '{tmp_path}/db'")
    spark.range(3).write.parquet(f"{tmp_path}/files")
    C.promote(spark, ("lookup", "sales_2024"), f"{tmp_path}/files")
    assert C.find(spark, "sales_*") == [("lookup", "sales_2024")] and C.find(spark, "sales_*", "default") == []
    assert C.at_path(spark, f"{tmp_path}/files", "lookup") == ("lookup", "sales_2024") and C.at_path(spark, f"{tmp_path}/other", "lookup") is None
    gone, schema = C.download(spark, "lookup.nothing")
    assert gone.columns == [] and gone.count() == 0 and schema == {}
    spark.sql("DROP DATABASE lookup CASCADE")


def test_runs_by_themselves_and_what_is_not_found(spark, tmp_path, caplog):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.csv").write_text("x,y\n1,2\n3,4\n")
    store = K.ReportStore(str(tmp_path / "runs"))
    with caplog.at_level("INFO", "sparkgauge.plans.assistant"):
        good, thread = run_async(spark, SourceConfig("local", str(tmp_path / "data")), store, anomalies=AnomalyConfig(use_isolation_forest=False))
        thread.join(120)
        bad, thread = run_async(spark, SourceConfig("local", str(tmp_path / "nowhere")), store)
        thread.join(120)
    index = store.index()
    assert index[good]["status"] == "complete" and store.found(good)["datasets"][0]["rows"] == 2
    assert index[bad]["status"] == "error" and index[bad]["error"] and set(index) == {good, bad}
    events = [json.loads(r.getMessage()) for r in caplog.records if r.name == "sparkgauge.plans.assistant"]
    assert [(e["run"], e["event"]) for e in events] == [(good, "start"), (good, "complete"), (bad, "start"), (bad, "error")]
    with pytest.raises(KeyError):
        store.found(bad)
    with pytest.raises(KeyError):
        store.found_artifact(good, "none.csv")


def test_truth_records_lie_beside_variants(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "id % 7 AS v", "'a@example.org' AS mail")
    variants(df, "t", ["id"], str(tmp_path), scenarios={"medium_quality": D.SCENARIOS["medium_quality"]})
    record = json.loads(spark.read.text(f"{tmp_path}/t_medium_quality_truth.json").first().value)
    assert record["row_count"] == 100 and record["expected_semantic_types"] == {"mail": "Email"}
    assert record["degradation_metadata"]["missing"] == {"share": 0.1, "rows": 10} and record["degradation_metadata"]["duplicates"]["rows"] == 5


def _csv(tmp_path, text):
    path = tmp_path / "x.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("text, columns, rows", [
    ("a,b\n1,x\n2,\n", ["a", "b"], [(1, "x"), (2, None)]),
    ("a,b\n1,2\n3,4,5\n", ["column_0", "column_1", "column_2"], [("a", "b", None), ("1", "2", None), ("3", "4", 5)]),
    ("1,2,3\n4,5\n", ["column_0", "column_1", "column_2"], [(1, 2, 3), (4, 5, None)]),
    ('k,t\n1,"a, b, c"\n2,x,y\n', ["column_0", "column_1", "column_2"], [("k", "t", None), ("1", "a, b, c", None), ("2", "x", "y")]),
    ("n,d,t,f\n1,2024-01-02,true,1.5\n-7,2024-02-03,FALSE,2\n", ["n", "d", "t", "f"], None),
    ("a,b\n", ["a", "b"], []),
])
def test_csv_keeps_every_field(spark, tmp_path, text, columns, rows):
    df = read_csv(spark, _csv(tmp_path, text))
    assert df.columns == columns
    if rows is None:
        assert [f.dataType.simpleString() for f in df.schema.fields] == ["int", "date", "boolean", "double"]
    else:
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)


def test_csv_rejects_and_limits(spark, tmp_path):
    path = _csv(tmp_path, "a,b\n1,2\n3\n4,5,6\n7,8\n")
    assert sorted(r.line for r in rejects(spark, path).collect()) == ["3", "4,5,6"]
    assert read_csv(spark, path, 1).columns == ["a", "b"]  # the lines that don't fit come later
    assert read_csv(spark, path, 3).count() == 3


def test_json_arrays_of_every_partition(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(10)], "i long, t string").repartition(3)
    path = str(tmp_path / "a")
    K.write(df, path, "json_array")
    files = [f.read_text() for f in (tmp_path / "a").glob("part-*")]
    assert sorted(x["i"] for f in files for x in json.loads(f)) == list(range(10)) and all(set(x) == {"i", "t"} for f in files for x in json.loads(f))
    K.write(df.limit(0), path, "json_array")
    assert all(json.loads(f.read_text()) == [] for f in (tmp_path / "a").glob("part-*"))


def test_json_arrays_of_bounded_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("id AS i", "repeat('x', 90) AS t").coalesce(1)
    K.write_json_array(df, str(tmp_path / "a"), 1 << 15)
    files = list((tmp_path / "a").glob("part-*"))
    assert max(f.stat().st_size for f in files) < 1.2 * (1 << 15)
    assert sorted(x["i"] for f in files for x in json.loads(f.read_text())) == list(range(4000))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "a")).count() == 4000
    K.write_json_array(df, str(tmp_path / "b"), None)
    assert len(list((tmp_path / "b").glob("part-*"))) == 1


def test_import_by_balanced_ranges(spark, tmp_path):
    url = "jdbc:derby:memory:ranges;create=true"
    keys = [*range(0, 400), *range(100_000, 100_020), None, None]
    spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").write.format("jdbc").options(url=url, dbtable="dense").mode("overwrite").save()
    ranges = C.key_ranges(spark, url, "dense", "k", rows=50)
    sizes = [spark.read.jdbc(url, "dense", predicates=[r]).count() for r in ranges]
    assert sum(sizes) == len(keys) and len(ranges) > 1
    (path,) = C.import_tables(spark, url, ["dense"], str(tmp_path), rows=50)
    assert sorted(r.k or -1 for r in spark.read.parquet(path).collect()) == sorted(k or -1 for k in keys)
    assert C.key_ranges(spark, url, "dense", "k") == ["1 = 1"]


def test_all_flagged_rows_are_listed(spark, tmp_path):
    df = with_row_index(spark.range(3000).selectExpr("CASE WHEN id % 2 = 0 THEN id END AS x", "id AS y"))
    config = AnomalyConfig(use_isolation_forest=False)
    report = find_anomalies(df, "a/b", config, str(tmp_path), max_listed_rows=10)
    assert report["anomalies"]["missing_values"] == 1500 and len(report["anomaly_rows"]["missing_values"]) == 10
    saved = spark.read.parquet(report["anomaly_rows_saved"])
    assert saved.where("method = 'missing_values'").count() == 1500


def test_find_goes_down_namespaces(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS deep")
    spark.range(1).write.mode("overwrite").saveAsTable("deep.seek_me")
    assert ("deep", "seek_me") in C.find(spark, "seek*") and C.find(spark, "seek*", "deep") == [("deep", "seek_me")]
    assert ("deep",) in C.namespaces(spark) and C.namespaces(spark, "deep") == [("deep",)]
    spark.sql("DROP DATABASE deep CASCADE")


def test_first_values_of_all_columns(spark):
    from sparkgauge.functions.firsts import first_values, head

    df = with_row_index(spark.range(0, 5000, 1, 4).selectExpr("CAST(id AS STRING) AS a", "CASE WHEN id >= 4000 THEN CAST(id AS STRING) END AS late", "CAST(NULL AS STRING) AS none", "CASE WHEN id % 100 = 7 THEN 'x' || id END AS few"))
    for order in (["row_idx"], ["a"]):
        got = {}
        for r in first_values(df, ["a", "late", "none", "few"], 20, order).collect():
            got.setdefault(r.column, []).append(r.value)
        rows = sorted(df.collect(), key=lambda r: r[order[0]])
        for c in ("a", "late", "none", "few"):
            assert sorted(got.get(c, [])) == sorted([r[c] for r in rows if r[c] is not None][:20])
    assert head(df, 3, ["row_idx"]).count() == 3
