"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on node id. A node with very many neighbours is a skewed
join key, never a collected group, so Spark's skew handling can split it. Rounds end in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.tables import drop_table, write_table



def _state(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _point_to_least(edges: DataFrame) -> DataFrame:
    """Large-star: every larger neighbour of a node is linked to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _gather_smaller(edges: DataFrame) -> DataFrame:
    """Small-star: a node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction, repeats and loops allowed -> ``(node, root)``: the least node
    that each linked node reaches. Nodes without a link to another node, and null ends, have no row."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = write_table(pairs)
    state = _state(now)
    while True:
        following = write_table(_gather_smaller(_point_to_least(now)))
        reached = _state(following)
        drop_table(now)
        now = following
        if reached == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = reached
