"""Centroid clustering by sort-means, over integers.

Components are floor(scale * x), so all sums, distances and means are exact and no result depends on the partitioning.

Each round orders, for every centroid, the others by their distance from it. A vector is scanned from its previous centroid:
the others come in that order, and the scan stops strictly beyond twice the current distance (4 times, squared), as no
centroid from there on can be as near; a centroid at just that bound may tie, and the smaller number wins. Arrow batches hold
all vectors of one previous centroid together, so a scan step is one array operation over the vectors that haven't stopped.

Every round is one pass: it writes the vectors with their new centroid and, beside them, each batch's sums by centroid, whose
total is k rows. Only those and the k centroids come to the driver; nothing is shuffled by centroid, however many vectors one
has. A lost executor repeats its part of one round.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component, or one whose integer
reaches 2**56, are left out; null and repeated ids are rows of their own; first centroids tie by their components; with
fewer than ``k`` vectors all are first centroids; a centroid without vectors stays; distances and sums beyond 64 bits come out null, though they
are compared exactly; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Context, Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, table, written

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: Components from here on are left out: sums of squares stay within 38 digits.
LIMIT = 2**56
_WIDE = pa.decimal128(38, 0)
_EXACT = Context(prec=38)


def quantised(df: DataFrame, id: str, vector: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(id, q) of the vectors that are kept, with q the components' integers."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda x: F.coalesce(F.abs(x * scale) < LIMIT, F.lit(False)) & ~F.isnan(x))
    return df.where(F.size(v) == dims).where(fits).select(F.col(id).alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("q"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of ``seed:id``, in that order; null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.q) for r in vectors.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()]


def _numbers(rows: list | np.ndarray, bound: int) -> np.ndarray:
    """Doubles where all sums of squares are exact in them, else Python's integers."""
    return np.asarray(rows, dtype=np.float64 if bound else object)


def _squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


def nearest(x: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each vector, by sort-means from the previous assignment."""
    best, least = previous.copy(), _squares(x - centroids[previous])
    for c in np.unique(previous):
        own = np.flatnonzero(previous == c)
        own = own[np.argsort(-least[own], kind="stable")]  # those that scan furthest come first
        current = least[own]
        gaps = _squares(centroids - centroids[c])
        for other in sorted((o for o in range(len(centroids)) if o != c), key=lambda o: (gaps[o], o)):
            live = own[: int(np.count_nonzero(4 * current >= gaps[other]))]
            if not len(live):
                break
            d = _squares(x[live] - centroids[other])
            better = (d < least[live]) | ((d == least[live]) & (other < best[live]))
            least[live[better]], best[live[better]] = d[better], other
    return best, least


def _decimals(values: Iterable) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _WIDE)


def _round(batches: Iterable[pa.RecordBatch], centroids: list[list[int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The vectors of each batch with their centroids, then a row of sums for each centroid that has some."""
    dims = len(centroids[0])
    most = max((abs(v) for c in centroids for v in c), default=0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
        span = max(most, int(q.max()), -int(q.min()))
        small = max(n, dims * 4 * span) * max(1, span) < 2**53
        x, c = _numbers(q if small else q.tolist(), small), _numbers(centroids, small)
        best, least = nearest(x, batch.column("cluster").to_numpy().astype(np.int64), c)
        none = lambda size, kind: pa.nulls(size, kind)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), pa.array(best, pa.int32()), _decimals(least), none(n, pa.int64()), none(n, schema.field("sums").type)], schema=schema)
        held, counts = np.unique(best, return_counts=True)
        sums = [x[best == c].sum(axis=0) for c in held]
        flat = _decimals(v for s in sums for v in s)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dims, pa.int32()), flat)
        m = len(held)
        yield pa.RecordBatch.from_arrays([none(m, schema.field("id").type), none(m, schema.field("q").type), pa.array(held, pa.int32()), none(m, _WIDE), pa.array(counts, pa.int64()), lists.cast(schema.field("sums").type)], schema=schema)


def _assigned(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    kind = state.schema["id"].dataType
    fields = [T.StructField("id", kind), T.StructField("q", T.ArrayType(T.LongType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DecimalType(38, 0)), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))]
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    return written(state.select("id", "q", "cluster").mapInArrow(partial(_round, centroids=centroids, schema=to_arrow_schema(schema)), schema))


def _moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Means of the vectors by centroid, from the sums of the batches: as many rows as there are centroids."""
    dims = len(centroids[0])
    totals = state.where(F.col("n").isNotNull()).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    out = [list(c) for c in centroids]
    for r in totals.collect():
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def sort_means(df: DataFrame, id: str, vector: str, dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that is kept, with distance a decimal, and the centroids."""
    vectors = written(quantised(df, id, vector, dims, scale).withColumn("cluster", F.lit(0)))
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("id", "cluster", F.lit(0).cast("decimal(38,0)").alias("distance")), []
    state = vectors
    for _ in range(rounds):
        after = _assigned(state.where("q IS NOT NULL"), centroids)
        released(state)
        centroids, state = _moved(after, centroids), after
    last = _assigned(state.where("q IS NOT NULL"), centroids)
    released(state)
    return last.where("q IS NOT NULL").select("id", "cluster", "distance"), centroids


def _long(value: Column) -> Column:
    return value.try_cast("bigint")


def op11(spark, sf_dir: str) -> DataFrame:
    rows, centroids = sort_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    inertia = written(rows.groupBy("cluster").agg(F.try_sum("distance").alias("of_cluster")))
    total = inertia.agg(F.try_sum("of_cluster").alias("total"))
    digests = spark.createDataFrame([(c, digest(v)) for c, v in enumerate(centroids)], "cluster int, centroid_sha256 string")
    facts = inertia.join(digests, "cluster").crossJoin(total)  # a row for each centroid
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", _long(F.col("distance")).alias("distance"), _long(F.col("of_cluster")).alias("cluster_inertia"), _long(F.col("total")).alias("inertia"), "centroid_sha256"
    )


def _sql() -> str:
    """Plain rounds over all centroids."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT c, q FROM (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1)::INT AS c, q FROM kept) WHERE c < {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rn, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d
  FROM (SELECT rn, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (kept.q[i] - c{r}.q[i]) * (kept.q[i] - c{r}.q[i])))::BIGINT AS d FROM kept CROSS JOIN c{r}) GROUP BY rn)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(range(1, {DIMS + 1})) AS i, unnest(q) AS x FROM a{r} JOIN kept USING (rn)) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (rn) JOIN c{ROUNDS} k ON k.c = a.c
"""


OP11_SQL = _sql()
