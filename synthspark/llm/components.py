"""Connected components of an edge table by alternating stars.

Each round hangs every node's neighbours on the smallest node it knows, first the larger ones (large star), then the
smaller ones (small star). All steps are grouped minima with map-side combining and equi-joins that adaptive execution
can split, so a node with millions of links is no single task's work. Rounds grow with the logarithm of the diameter
and are cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthspark.session import cut_lineage


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("big", "small")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("big").alias("node"), F.col("small").alias("other")).union(
        edges.select(F.col("small").alias("node"), F.col("big").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("big"), F.col("low").alias("small")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("big").agg(F.min("small").alias("low"))
    moved = edges.join(least, "big").where("small > low").select(F.col("small").alias("big"), F.col("low").alias("small"))
    return moved.union(least.select("big", F.col("low").alias("small"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, root)`` for every node that has a link to another one; ``root`` is the smallest node reachable.

    Null ends and loops are ignored; repeated and reversed links count once. Linkless nodes do not appear.
    """
    edges = (
        links.select(F.greatest(left, right).alias("big"), F.least(left, right).alias("small"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("big") != F.col("small")))
        .distinct()
    )
    edges = cut_lineage(edges)
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_small_star(_large_star(edges)))
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("big").alias("node"), F.col("small").alias("root"))
    return roots.union(edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
