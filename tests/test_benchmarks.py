from sparkgauge.plans import benchmarks as B


def test_mapping_benchmark(spark):
    rows = {r.transform: r for r in B.mapping_benchmark(spark).collect()}
    assert set(rows) == set(B.TRANSFORM_NAMES) and rows["exact"].f1 == 1.0 and rows["synonym"].recall > 0.8
    assert all(r.tp + r.fp + r.fn == len(B.FIELDS) for r in rows.values())


def test_abbreviations(spark):
    rows = {r.source: r for r in B.abbreviation_benchmark(spark, lambda p: "first_name").collect()}
    assert len(rows) == 15 and rows["first_nme"].assisted == "first_name" and rows["fgm"].status != "mapped"


def test_folder_diffs(spark, tmp_path):
    (tmp_path / "v1.csv").write_text("Id,Name\n1,a\n")
    (tmp_path / "v2.csv").write_text("Id,Name,Mail\nx,a,m\n")
    out = B.folder_diffs(spark, str(tmp_path), str(tmp_path / "out"))
    assert out == {"v2.csv": {"added": {"mail": "string"}, "removed": {}, "changed": {"id": {"old": "int", "new": "string"}}}}
    assert (tmp_path / "out" / "v1.csv.schema.json").exists() and "mail: string" in (tmp_path / "out" / "v2.csv.diff.txt").read_text()


def test_generated(spark, tmp_path):
    names = B.generated(spark, {"t": {"a": "int", "b": "string"}}, str(tmp_path), 40, ["high_quality"])
    assert names == ["t_high_quality"] and spark.read.parquet(str(tmp_path / "t_high_quality_truth")).count() > 0
