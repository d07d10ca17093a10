"""Connected components by contraction.

Edges are pairs of ids that can be ordered. In a round every node takes its smallest neighbour, if that is smaller, as its
parent: a grouped minimum with a partial aggregate. The trees that result are flattened by doubling, edges between trees
stay, and rounds go on until there are none; two rounds at least halve the nodes. No neighbourhood is gathered in one
task, joins on a hub are dealt over tasks, and each step is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, spread, written

MAX_ROUNDS = 60


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) of a written forest (node, up)."""
    held = parents
    for _ in range(MAX_ROUNDS):
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        out = spread(parents, above, "up", F.xxhash64("node"), "left")
        out = written(out.select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        released(held)
        if out.where("moved").isEmpty():
            return out.select("node", F.col("up").alias("root"))
        held, parents = out, out.drop("moved")
    raise RuntimeError("trees didn't end")


def _named(edges: DataFrame, roots: DataFrame, end: str, other: str) -> DataFrame:
    out = spread(edges, roots.select(F.col("node").alias(end), "root"), end, F.xxhash64(other), "left")
    return written(out.select(F.coalesce("root", end).alias(end), other))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge to another; the root itself is left out. ``edges`` has u and v."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    found = None
    for _ in range(MAX_ROUNDS):
        roots = _flat(written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up"))))
        if found is None:
            found = roots
        else:
            top = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            joined = spread(found, top, "root", F.xxhash64("node"), "left").select("node", F.coalesce("top", "root").alias("root"))
            found = written(joined.unionByName(roots))
        half = _named(edges, roots, "u", "v")
        moved = _named(half, roots, "v", "u")
        rest = written(moved.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        released(edges, half, moved)
        if rest.isEmpty():
            return found
        edges = rest
    raise RuntimeError("components didn't settle")
