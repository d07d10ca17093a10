import pytest

from sparkgauge.functions.order import quantiles, seeded_hash, smallest
from sparkgauge.functions.types import numeric_columns, with_row_index
from sparkgauge.operators import anomalies as A
from sparkgauge.operators.forest import isolation_forest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, 10.5, "A", 1.0), (2, 12.0, "A", None), (3, 11.5, "B", 3.0), (4, 100.0, "A", None), (5, 10.9, "C", 5.0)]
    return spark.createDataFrame(rows, "id long, value double, category string, missing_col double")


def test_zscore(numbers):
    assert [r.value for r in A.zscore(numbers, "value", 1.5).collect()] == [100.0]
    assert A.zscore(numbers, "value", 3.0).count() == 0


def test_iqr(numbers):
    assert [r.value for r in A.iqr(numbers, "value").collect()] == [100.0]


def test_forest_flags_the_outlier_and_repeats(numbers):
    a = isolation_forest(numbers, ["id", "value"], 0.2, 100, 42)
    found = [r.value for r in a.collect()]
    assert 100.0 in found
    assert found == [r.value for r in isolation_forest(numbers, ["id", "value"], 0.2, 100, 42).collect()]
    assert all(r.is_anomaly for r in a.collect())


def test_forest_leaves_out_missing_features(spark):
    df = spark.createDataFrame([(float(i), None if i == 7 else float(i % 3)) for i in range(50)] + [(1000.0, 50.0), (float("nan"), 1.0)], "a double, b double")
    found = isolation_forest(df, ["a", "b"], 0.05).collect()
    assert (1000.0, 50.0) in [(r.a, r.b) for r in found]
    assert all(r.b is not None and r.a == r.a for r in found)


def test_errors(numbers):
    with pytest.raises(ValueError, match="Unknown method"):
        A.detect(numbers, "invalid")
    with pytest.raises(KeyError, match="Column 'non_existent' does not exist in the DataFrame."):
        A.detect(numbers, "zscore", ["non_existent"])
    with pytest.raises(ValueError):
        A.detect(numbers, "iqr", ["id", "value"])


@pytest.mark.parametrize(
    ("rows", "threshold", "expected"),
    [
        ([(1, 10, 100), (2, 20, 200), (None, 30, 300), (4, None, 400), (5, 50, 500)], 1, [(None, 30), (4, None)]),
        ([(1, 10, 100), (None, None, None), (None, 30, 300), (4, 40, 400), (5, None, 500)], 2, [(None, None)]),
        ([(1, 10, 100)], 1, []),
        ([], 1, []),
        ([(None, None, None)] * 3, 1, [(None, None)] * 3),
        ([(None, None, 1), (2, 20, 2), (3, 30, 3)], 3, []),
    ],
)
def test_missing_rows(spark, rows, threshold, expected):
    df = spark.createDataFrame(rows, "a int, b int, c int")
    found = A.missing_rows(df, threshold)
    assert found.columns == ["a", "b", "c"]
    assert [(r.a, r.b) for r in found.collect()] == expected


def test_missing_is_empty_but_not_blank_or_nan(spark):
    df = spark.createDataFrame([("", 1.0), (" ", 1.0), ("x", float("nan"))], "s string, d double")
    assert [r.s for r in A.missing_rows(df).collect()] == [""]


def test_no_spread(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,), (2.0,)], "x double")
    assert A.zscore(df.where("x = 1"), "x").count() == 0
    assert [r.x for r in A.iqr(df, "x").collect()] == [2.0]  # every value but the quartiles
    assert A.iqr(df.where("x > 5"), "x").count() == 0


def test_rare_value_is_strictly_below_one_percent(spark):
    df = spark.createDataFrame([("a",)] * 197 + [("b",)] * 2 + [("c",)], "s string")
    assert [r.s for r in A.rare_categories(df).collect()] == ["c"]
    assert A.rare_categories(df.where("s = 'z'")).count() == 0


def test_quantiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(size=70_000), np.repeat(0.5, 5_000)])
    df = spark.createDataFrame([(float(x), None) for x in data], "x double, y double")
    got = quantiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.0, 0.25, 0.5, 0.75, 0.99, 1.0))
    assert got["x"] == pytest.approx(np.percentile(data, [0, 25, 50, 75, 99, 100]).tolist(), abs=1e-12)
    assert got["y"] == [None] * 6


def test_smallest_takes_exactly_k(spark):
    df = spark.range(5000)
    h = seeded_hash("s", F.col("id"))
    for k in (0, 1, 777, 5000, 9000):
        assert df.where(smallest(df, h, k)).count() == min(k, 5000)


def test_row_index_is_dense(spark):
    df = with_row_index(spark.range(1000).repartition(7).select("id"))
    assert sorted(r.row_idx for r in df.collect()) == list(range(1000))
    assert numeric_columns(df) == ["id"]


def test_flags_count_a_row_for_each_column(spark):
    rows = [(float(i % 5), float(i % 7), "k") for i in range(100)] + [(1e6, 1e6, "k")]
    out = A.flags(spark.createDataFrame(rows, "a double, b double, s string")).where("size(flags.zscore) > 0").collect()
    assert len(out) == 1 and out[0].flags.zscore == ["a", "b"]


def test_forest_scores_against_a_plain_walk(spark):
    """Every row's path through every tree, one by one, with the published normalisation, and the rows above the quantile."""
    import math
    import random

    import numpy as np

    from sparkgauge.operators.forest import fitted, forest_scores, isolation_forest

    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2) if i % 50 else 40.0) for i in range(400)] + [(400, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    trees, size = fitted(df, ["a", "b"], 20)
    expected = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def path(tree, x):
        at, steps = 0, 0
        while tree[at][0] >= 0:
            at, steps = int(tree[at][2] if x[int(tree[at][0])] < tree[at][1] else tree[at][3]), steps + 1
        return steps + tree[at][4]

    want = {i: 2 ** (-sum(path(t, (a, b)) for t in trees) / len(trees) / expected(size)) for i, a, b in rows if a is not None}
    got = {r.id: r.anomaly_score for r in forest_scores(df, ["a", "b"], 20).collect()}
    assert got.pop(400) is None and got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9
    cut = np.quantile(list(want.values()), 0.95)
    flagged = {r.id for r in isolation_forest(df, ["a", "b"], 0.05, 20).collect()}
    assert flagged == {i for i, v in want.items() if v > cut} and len(flagged) >= 8


def test_forest_flags_its_share_among_equal_scores(spark):
    df = spark.range(600).selectExpr("id", "double(id % 20) AS a", "double(id % 20 = 0) AS b", "map(id, a) AS m")  # 30 copies of each point
    found = isolation_forest(df.repartition(3), ["a", "b"], 0.02, 20)
    ids = sorted(r.id for r in found.collect())
    assert len(ids) == 12 and len({i % 20 for i in ids}) == 1 and found.columns == [*df.columns, "is_anomaly"]
    assert ids == sorted(r.id for r in isolation_forest(df.repartition(5), ["a", "b"], 0.02, 20).collect())
    assert A.detect(spark.createDataFrame([(1.0, 2.0)] * 40, "a double, b double"), "isolation_forest", contamination=0.1, n_estimators=5).count() == 4


def test_forest_scores_many_rows_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from sparkgauge.operators.forest import forest_scores
    from sparkgauge.sources import files

    assert files.spread(spark.range(900).coalesce(1), 100).rdd.getNumPartitions() == 9
    assert files.spread(spark.range(90).coalesce(1), 100).rdd.getNumPartitions() == 1
    assert files.spread(spark.range(0), 100).count() == 0
    n = 3 * files.SPREAD_ROWS
    spark.range(n).selectExpr("double(id % 1000) AS a", "double(id % 7) AS b").coalesce(1).write.parquet(str(tmp_path / "t"))  # a small file of one row group
    scored = forest_scores(spark.read.parquet(str(tmp_path / "t")), ["a", "b"], 5)
    tasks = scored.select("anomaly_score", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == 3 and sum(r["count"] for r in tasks) == n
