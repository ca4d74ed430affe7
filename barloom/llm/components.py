"""Connected components of a large undirected graph by alternating stars.

Every round first hangs each node's larger neighbours on its smallest neighbour,
then each node and its smaller neighbours on the smallest of them. The number of
edges never grows, the rounds are about the logarithm of the longest chain, and a
node with very many edges is only ever reduced by ``min`` before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

MAX_ROUNDS = 100


def _star(edges: DataFrame, smaller: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if smaller:
        around, keep = edges, edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        keep = around
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = keep.join(least, "u")
    if smaller:
        pairs = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        pairs = pairs.unionByName(own)
    else:
        pairs = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = pairs.unionByName(
            joined.where("v < u").where("v = m").select("u", "v")
        )
    return pairs.where("u > v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has an edge to another node.

    ``component`` is the smallest node that can be reached. Null ends and loops
    are no edges; repeated edges count once; no edges give an empty frame.
    """
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    current = materialize(
        ends.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _fingerprint(current)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        current = materialize(_star(_star(current, smaller=False), smaller=True), "edges")
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots.distinct())
