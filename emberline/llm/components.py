"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: Edges of one node from which a hub's minima are a table of their own, so that adaptive execution may split their join.
HUB = 1 << 20


def _state(edges: DataFrame) -> tuple:
    """Number and hash of the edges, and the most that one centre has."""
    by = edges.groupBy("v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
    return tuple(by.agg(F.sum("n"), F.bit_xor("h"), F.max("n")).first())


def connected_components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(id, component) for every node of edges (u, v); component is the least id that is reachable.

    A large-star step links each node's greater neighbours to the least node of its neighbourhood, a small-star step its
    lesser ones; in turns they end in stars around the least nodes. Each round's edges are cut to the shared folder. A
    node's edges meet only partial minima, in sort-merge joins, never one list. Such a join is split only if both of its
    sides are plain shuffles; so where a node has `hub` edges or more, the minima are cut to a table before they are joined.
    """
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while True:
        apart = cut if (state[2] or 0) >= hub else lambda df: df
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = apart(large)
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = cut(small)
        if (new := _state(e))[:2] == state[:2]:
            break
        state = new
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
