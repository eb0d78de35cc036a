"""Connected components of a graph given by its edges: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import cut, near_lookup

#: Edges that a task of a checkpointed round holds, about.
EDGES = 100_000


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge to another one in ``edges`` (a, b): its smallest reachable node.

    In a large-star round each node connects its larger neighbours to the smallest node that it sees, in a
    small-star round its smaller ones; the number of rounds grows with the logarithm of the longest path. Each
    round is checkpointed in the shared folder, in as many parts as its edges need, so that small graphs make few files. Minima are
    pre-aggregated; up to a checked number they are broadcast, beyond it a hub's edges are salted, so
    no task gets a hub's whole neighbourhood. Roots aren't listed. Null ends and self-loops are ignored.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = seen
        n = seen[0]
        parts = n // EDGES + 1
        now = now.coalesce(parts)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = near_lookup(both, _least_neighbour(both), ["u"], 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct().coalesce(parts))
        least = _least_neighbour(large)
        small = near_lookup(large, least, ["u"], n, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
