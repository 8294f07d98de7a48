"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.session import cut_lineage


def _to_smallest(arcs: DataFrame) -> DataFrame:
    """``arcs(u, v)``: link every v, and u itself, to the smallest of v's of u and u."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # The join follows a key with many rows; adaptive execution splits such partitions, as the next step groups by other keys.
    return arcs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Return ``node``, ``root``: the smallest node that each node of an edge reaches.

    Nodes are of any ordered type. Edges with a null end and edges from a node to itself link nothing; repeated edges
    count once; an empty table gives an empty result. Nodes without a link have no row. Every round is written to the
    checkpoint folder, so a lost executor repeats one round at most. The number of rounds grows with the logarithm of
    the number of nodes, not with the length of chains.
    """
    pairs = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )
    pairs = cut_lineage(pairs)
    seen = None
    for _ in range(max_rounds):
        # Large star: the larger neighbours of every node go to its smallest neighbour or itself.
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v").distinct()
        )
        # Small star: each node's smaller neighbours, and the node, go to the smallest of them.
        joined = _to_smallest(large)
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(joined.select("u", F.col("m").alias("v")))
            .where("u != v").distinct()
        )
        pairs = cut_lineage(small)
        # Done when no round changes the edges: their number and a sum over them stay.
        now = pairs.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2_147_483_647)).cast("decimal(38,0)"))
        ).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())
