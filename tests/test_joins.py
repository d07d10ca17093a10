"""As-of and interval joins against plain loops, with hot keys, ties, nulls and infinite ends."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators.joins import asof_join, interval_join

NAN, INF = math.nan, math.inf


def rank(v):
    """Spark's order: NaN above all numbers."""
    return (isinstance(v, float) and math.isnan(v), v if not (isinstance(v, float) and math.isnan(v)) else 0)


def plain_asof(left, right, direction="backward", strict=False, tolerance=None):
    """Rows are (id, key, t); of equal times the greatest row counts."""
    out = []
    for i, k, t in left:
        best = None
        for row in right:
            j, rk, rt = row
            if None in (k, t, rk, rt) or rk != k:
                continue
            a, b = rank(rt), rank(t)
            if (a > b if direction == "backward" else a < b) or (strict and a == b):
                continue
            nearer = best is None or (a > rank(best[2]) if direction == "backward" else a < rank(best[2])) or (a == rank(best[2]) and (j, rk) > best[:2])
            best = row if nearer else best
        if best is not None and tolerance is not None and abs(t - best[2]) > tolerance:
            best = None
        out.append((i, k, t, None if best is None else best[0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.id, r.k, r.t, None if r.matched is None else r.matched.id) for r in df.collect()), key=repr)


def table(spark, rows, kind="double", parts=5):
    return spark.createDataFrame(rows, f"id long, k string, t {kind}").repartition(parts)


def events(seed, n, keys=("a", "b", None), times=40):
    r = random.Random(seed)
    return [(i, r.choice(keys), r.choice([None, float(r.randrange(times)), float(r.randrange(times)) / 2])) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, direction, strict):
    left, right = events(1, 150), events(2, 120)
    want = plain_asof(left, right, direction, strict)
    for rows, hot in ((25, 3), (1 << 18, 1 << 12))[: 1 if strict else 2]:  # many buckets, with cells split; one
        got = asof_join(table(spark, left), table(spark, right), "t", ["k"], direction, strict, bucket_rows=rows, hot_rows=hot)
        assert rows_of(got) == want
        assert got.columns == ["id", "k", "t", "matched"]


def test_asof_carries_over_many_buckets(spark):
    """The last right row of a key may lie many buckets back; one key has nearly all rows."""
    left = [(i, "hot" if i % 9 else "cold", float(i)) for i in range(400)]
    right = [(0, "cold", 1.5), (1, "hot", 2.5)] + [(i, "hot", float(i)) for i in range(3, 300, 7)]
    got = asof_join(table(spark, left), table(spark, right), "t", ["k"], bucket_rows=20, hot_rows=4)
    assert rows_of(got) == plain_asof(left, right)
    got = asof_join(table(spark, left), table(spark, right), "t", ["k"], "forward", bucket_rows=20, hot_rows=4)
    assert rows_of(got) == plain_asof(left, right, "forward")


def test_asof_keeps_equal_rows_and_clashing_names(spark):
    left = spark.createDataFrame([(1, "a", 5.0, 1)] * 4 + [(2, "b", 1.0, 2)], "id long, k string, t double, _row int")
    right = spark.createDataFrame([("a", 4.0, 9, 1), ("a", 4.0, 10, 2)], "k string, u double, id long, matched int")
    got = asof_join(left, right, ("t", "u"), [("k", "k")], ties=["matched"], hot_rows=1).collect()
    assert [r.matched.id for r in got if r.id == 1] == [10] * 4 and [r.matched for r in got if r.id == 2] == [None]
    assert asof_join(left, right, ("t", "u"), ["k"], how="inner").count() == 4


def test_asof_with_nan_without_keys_and_with_tolerance(spark):
    left, right = [(1, "a", NAN), (2, "a", 3.0), (3, None, INF), (4, "z", -INF)], [(7, "b", 1.0), (8, "b", NAN), (9, "c", INF)]
    plain = [(i, "", t) for i, _, t in left], [(i, "", t) for i, _, t in right]
    want = {i: m for i, _, _, m in plain_asof(*plain)}
    assert {r.id: r.matched and r.matched.id for r in asof_join(table(spark, left), table(spark, right), "t").collect()} == want == {1: 8, 2: 7, 3: 9, 4: None}
    left, right = [(i, "a", float(i)) for i in range(20)], [(1, "a", 2.0), (2, "a", 15.0)]
    for direction in ("backward", "forward"):
        got = asof_join(table(spark, left), table(spark, right), "t", ["k"], direction, tolerance=F.lit(4.0))
        assert rows_of(got) == plain_asof(left, right, direction, tolerance=4.0)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date"])
def test_asof_of_times(spark, kind):
    at = (lambda n: date(2024, 1, 1) + timedelta(n)) if kind == "date" else (lambda n: datetime(2024, 1, 1) + timedelta(minutes=n))
    left, right = [[(i, k, None if t is None else at(int(t))) for i, k, t in events(s, 80)] for s in (3, 4)]
    got = asof_join(table(spark, left, kind), table(spark, right, kind), "t", ["k"], bucket_rows=20, hot_rows=4)
    assert rows_of(got) == plain_asof(left, right)


def test_asof_of_empty_tables(spark):
    some, none = table(spark, [(1, "a", 1.0)]), table(spark, [])
    assert rows_of(asof_join(some, none, "t", ["k"])) == [(1, "a", 1.0, None)]
    assert rows_of(asof_join(none, some, "t", ["k"])) == []
    with pytest.raises(ValueError):
        asof_join(some, some, "t", direction="sideways")


def plain_overlaps(left, right, keyed):
    out = []
    for a in left:
        for b in right:
            if keyed and (a[1] is None or a[1] != b[1]):
                continue
            ends = (*a[2:4], *b[2:4])
            if any(x is None or x != x for x in ends) or a[2] > a[3] or b[2] > b[3]:
                continue
            if a[2] <= b[3] and b[2] <= a[3]:
                out.append((a[0], b[0]))
    return sorted(out)


def spans(seed, n, scale=1000.0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.choice([round(r.uniform(0, scale), 1), float(r.randrange(int(scale)))])
        size = r.choice([0.0, r.random(), r.uniform(0, 5), r.uniform(0, 60), r.uniform(0, scale) if r.random() < 0.2 else 1.0])
        out.append((i, r.choice("ab"), start, start + size))
    odd = [(None, 1.0), (1.0, None), (5.0, 4.0), (NAN, 3.0), (-INF, 3.0), (990.0, INF), (-INF, INF)]
    return out + [(n + i, "a", s, e) for i, (s, e) in enumerate(odd)] + [(n + 20, None, 0.0, 10.0)]


def pairs(df):
    return sorted((r.left.id, r.right.id) for r in df.collect())


def span_table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"id long, k string, s {kind}, e {kind}").repartition(4)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("hot", [1 << 12, 3])
def test_intervals(spark, keyed, hot):
    left, right = spans(5, 120), spans(6, 90)
    got = pairs(interval_join(span_table(spark, left), span_table(spark, right), ("s", "e"), ("s", "e"), ["k"] if keyed else [], hot_rows=hot))
    assert got == plain_overlaps(left, right, keyed)
    assert len(got) == len(set(got)) > 250


def test_points_in_ranges_and_one_hot_place(spark):
    points = [(i, "a", float(i % 50), float(i % 50)) for i in range(200)] + [(200 + i, "a", 7.0, 7.0) for i in range(150)]
    ranges = [(i, "a", float(i), float(i + i % 3)) for i in range(60)] + [(60, "a", 0.0, 1e6)]
    got = pairs(interval_join(span_table(spark, points), span_table(spark, ranges), ("s", "e"), ("s", "e"), hot_rows=10))
    assert got == plain_overlaps(points, ranges, False)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "decimal(12,2)"])
def test_intervals_of_other_kinds(spark, kind):
    def at(x):
        if x is None or x != x or abs(x) == INF:
            return None
        whole = int(x)
        return {"date": lambda: date(2024, 1, 1) + timedelta(whole), "long": lambda: whole, "decimal(12,2)": lambda: __import__("decimal").Decimal(whole)}.get(kind, lambda: datetime(2024, 3, 30) + timedelta(minutes=whole))()

    left, right = [[(i, k, at(s), at(e)) for i, k, s, e in spans(n, 60, 300.0)] for n in (7, 8)]
    got = pairs(interval_join(span_table(spark, left, kind), span_table(spark, right, kind), ("s", "e"), ("s", "e"), ["k"]))
    assert got == plain_overlaps(left, right, True)


def test_candidates_stay_near_the_longer_interval(spark):
    """One interval over everything doesn't make all others meet."""
    rows = [(i, "a", float(i), i + 0.4) for i in range(3000)] + [(3000, "a", 0.0, 3000.0)]
    df = span_table(spark, rows)
    joined = interval_join(df, df, ("s", "e"), ("s", "e"))
    assert joined.count() == 3000 + 2 * 3000 + 1
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_empty_tables_and_unlike_kinds(spark):
    some, none = span_table(spark, [(1, "a", 1.0, 2.0)]), span_table(spark, [])
    assert pairs(interval_join(some, none, ("s", "e"), ("s", "e"))) == pairs(interval_join(none, none, ("s", "e"), ("s", "e"))) == []
    assert pairs(interval_join(some, some, ("s", "e"), ("s", "e"))) == [(1, 1)]
    with pytest.raises(ValueError):
        interval_join(some, span_table(spark, [], "date"), ("s", "e"), ("s", "e"))
