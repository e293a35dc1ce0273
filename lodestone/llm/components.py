"""Connected components by alternating large and small stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodestone.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (columns a, b); root is the least node of the component.

    Every round is linear in the edges: least neighbours are map-side combined, and joined back on the node.
    """
    pair = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    current = cut_lineage(pair.distinct())
    state = _state(current)
    while state[0]:
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).unionByName(joined.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        current = cut_lineage(small.distinct())
        before, state = state, _state(current)
        if state == before:
            break
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
