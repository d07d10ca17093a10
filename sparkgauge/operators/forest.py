"""Isolation forest (Liu, Ting and Zhou, 2008).

Each tree is grown by a task of its own from 256 rows, which seeded hashes of the tree and the row choose, so that a rerun on
any partitioning grows the same forest. All rows are scored by Arrow batches against the broadcast trees, whose size depends
on the settings alone; the rows of highest score are taken to the row.

Rows with a null or NaN feature are neither fitted nor flagged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import order_statistics, pick
from ..functions.types import ensure_columns, number, q
from ..sources.files import spread, stored

SAMPLE = 256


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree of ``n``."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth_left: int, rng: np.random.Generator, nodes: list[list[float]]) -> int:
    """Adds a node [feature, cut, left, right, path added at a leaf]; returns its place."""
    at = len(nodes)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 and depth_left else np.empty(0, dtype=int)
    if not len(spread):
        nodes.append([-1.0, 0.0, 0.0, 0.0, float(average_path(len(x)))])
        return at
    feature = int(rng.choice(spread))
    cut = rng.uniform(x[:, feature].min(), x[:, feature].max())
    nodes.append([float(feature), cut, 0.0, 0.0, 0.0])
    left = x[:, feature] < cut
    nodes[at][2] = _grow(x[left], depth_left - 1, rng, nodes)
    nodes[at][3] = _grow(x[~left], depth_left - 1, rng, nodes)
    return at


#: The trees as one run of arrays, for a walk of all rows at once: where each tree begins, its height, and by node the feature, the cut,
#: the nodes below (a leaf is its own), and the path to it with what a leaf adds.
Packed = tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _packed(trees: Sequence[np.ndarray]) -> Packed:
    starts, features, cuts, below, paths, at = [], [], [], [], [], 0
    for tree in trees:
        n, leaf = len(tree), tree[:, 0] < 0
        own = np.arange(n)
        low, high = (np.where(leaf, own, tree[:, i].astype(int)) for i in (2, 3))
        depth = np.zeros(n)
        for i in np.flatnonzero(~leaf):  # nodes stand before those below them
            depth[[low[i], high[i]]] = depth[i] + 1
        starts.append((at, int(depth.max())))
        features.append(np.where(leaf, 0, tree[:, 0]).astype(np.intp))
        cuts.append(tree[:, 1])
        below.append(at + np.stack([high, low], axis=1).ravel())
        paths.append(depth + tree[:, 4])
        at += n
    return starts, np.concatenate(features), np.concatenate(cuts), np.concatenate(below).astype(np.intp), np.concatenate(paths)


def _depths(packed: Packed, x: np.ndarray) -> np.ndarray:
    """Mean paths of rows. Trees are added up in turn, so equal rows get equal sums in any batch."""
    starts, features, cuts, below, paths = packed
    n = len(x)
    values, rows, total = np.ascontiguousarray(x.T).ravel(), np.arange(n), np.zeros(n)
    for start, height in starts:
        at = np.full(n, start)
        for _ in range(height):
            at = below[2 * at + (values[features[at] * n + rows] < cuts[at])]
        total += paths[at]
    return total / len(starts)


def _samples(df: DataFrame, columns: Sequence[str], n_estimators: int, seed: int) -> DataFrame:
    """(tree, h, x) with ``SAMPLE`` rows a tree: those of smallest hash of the tree and the row.

    Only the rows of smallest hash, ``SAMPLE`` for each tree, are dealt out. Equal rows are numbered, so that a tree may get some of
    them; which ones makes no difference. So samples follow from the rows alone, whatever their partitions.
    """
    x = [f"x{i}" for i in range(len(columns))]
    rows = df.select(*[(number(df, c) + F.lit(0.0)).alias(n) for n, c in zip(x, columns, strict=True)]).dropna()
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *x), 12)
    pool = pick(rows, "_in", n_estimators * SAMPLE, hashed).where("_in").select(*x)
    copy = F.row_number().over(Window.partitionBy(*x).orderBy(F.lit(0)))  # n_estimators * SAMPLE rows at most
    pool = stored(pool.withColumn("copy", copy))
    dealt = pool.select(F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))).alias("tree"), F.array(*x).alias("x"), "copy").withColumn("h", F.xxhash64(F.lit(seed), "tree", "copy", "x"))
    order = Window.partitionBy("tree").orderBy("h", "x", "copy")
    return dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE).select("tree", "rank", "x")


def _grown(sample: pd.DataFrame, seed: int) -> pd.DataFrame:
    """The nodes of one tree, from its sample."""
    tree = int(sample["tree"].iloc[0])
    x = np.array(sample.sort_values("rank")["x"].tolist(), dtype=float)
    nodes: list[list[float]] = []
    _grow(x, math.ceil(math.log2(max(len(x), 2))), np.random.Generator(np.random.PCG64([seed, tree])), nodes)
    out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "path"])
    out.insert(0, "tree", tree)
    out.insert(1, "node", range(len(nodes)))
    out["size"] = len(x)
    return out


FOREST = "tree int, node int, feature double, cut double, low double, high double, path double, size int"


def grown(df: DataFrame, columns: Sequence[str], n_estimators: int = 100, random_state: int = 42) -> DataFrame:
    """The forest as a table with a row for each node; no rows if no row of ``df`` is whole."""
    ensure_columns(df, columns)
    if random_state < 0:
        raise ValueError("random_state must not be negative")

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        return _grown(sample, random_state)

    return stored(_samples(df, columns, n_estimators, random_state).groupBy("tree").applyInPandas(grow, FOREST))


def fitted(df: DataFrame, columns: Sequence[str], n_estimators: int = 100, random_state: int = 42) -> tuple[list[np.ndarray], int]:
    """Trees, as arrays of nodes, and the size of their samples: 2 * SAMPLE nodes a tree at most, whatever the table."""
    nodes = grown(df, columns, n_estimators, random_state).toPandas().sort_values(["tree", "node"])
    trees = [t[["feature", "cut", "low", "high", "path"]].to_numpy() for _, t in nodes.groupby("tree")]
    return trees, int(nodes["size"].iloc[0]) if trees else 0


def forest_scores(df: DataFrame, columns: Sequence[str], n_estimators: int = 100, random_state: int = 42, score: str = "anomaly_score") -> DataFrame:
    """``df`` with a score in (0, 1), higher for rows that are isolated sooner; null where a feature is missing."""
    trees, size = fitted(df, columns, n_estimators, random_state)
    shared = df.sparkSession.sparkContext.broadcast((_packed(trees) if trees else None, float(average_path(size)) or 1.0))
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, norm = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(batch.num_columns - width + i).to_numpy(zero_copy_only=False) for i in range(width)]).astype(float)
            whole = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            if whole.any() and trees:
                out[whole] = 2.0 ** (-_depths(trees, x[whole]) / norm)
            kept = [batch.column(i) for i in range(batch.num_columns - width)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, mask=np.isnan(out))], [*batch.schema.names[: batch.num_columns - width], score])

    features = spread(df).select("*", *[number(df, c).alias(f"_feature_{i}") for i, c in enumerate(columns)])
    return features.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(score, T.DoubleType())]))


def _first_rows(scored: DataFrame, score: str, share: float, seed: int) -> DataFrame:
    """The rows of highest score, ``share`` of those that have one, rounded half up; of rows that share the last score as many as
    are left, by a hash of all their values."""
    n = scored.agg(F.count(score)).first()[0]
    k = int((Decimal(str(share)) * n).to_integral_value(ROUND_HALF_UP))
    if not k:
        return scored.where(F.lit(False))
    last = order_statistics(scored, [F.col(score)], {0: [n - k]})[1][0][n - k]
    above, tied = F.col(score) > F.lit(last), F.col(score) == F.lit(last)
    if scored.where(above | tied).count() == k:
        return scored.where(above | tied)
    values = [q(f.name) for f in scored.schema.fields if not any(word in f.dataType.simpleString() for word in ("map<", "variant"))]  # those can't be hashed
    place = F.when(above, 0).when(tied, F.shiftrightunsigned(F.xxhash64(F.lit(seed), *values), 13) + 1).otherwise(F.lit(2**52 - 1))
    return pick(scored, "_in", k, place).where("_in").drop("_in")


def isolation_forest(df: DataFrame, columns: Sequence[str], contamination: float = 0.01, n_estimators: int = 100, random_state: int = 42) -> DataFrame:
    """The flagged rows, with ``is_anomaly``; they are ``contamination`` of the whole rows, to the row, also where scores are equal."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    scored = stored(forest_scores(df, columns, n_estimators, random_state, "_score"))  # bound and rows come from one scoring
    return _first_rows(scored, "_score", contamination, random_state).drop("_score").withColumn("is_anomaly", F.lit(True))
