"""Connected components of a link table, without gathering links or neighbourhoods anywhere.

Alternating star contraction: every round hangs each node's larger neighbours onto its
least neighbour, then its smaller ones, by grouped minima and equi-joins alone. Chains of
n links need about log(n) rounds; stars need two. A hub's neighbours are dealt over SALTS
tasks when they are joined with its least one (and further by Spark's skew join, where that is
not enough).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


#: Tasks that one node's neighbours are dealt over in a join.
SALTS = 8


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs with m of `least` (one row per u), each u's pairs in SALTS parts."""
    copies = least.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "salt"]).drop("salt")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def components(links: DataFrame, a: str = "x", b: str = "y", rounds: int | None = None) -> DataFrame:
    """node, component (its least node) for every node that has a link to another node.

    Goes on until nothing changes; an error if that takes more than `rounds`, where given.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = materialize(edges)
    mark = _mark(edges)
    for k in count():
        if k == rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, _least(both).select("u", F.least("u", "m").alias("m"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # each u now has only smaller neighbours: hang them, and u, onto the least of them
        least = _least(large)
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        old, edges = edges, materialize(small)
        discard(old)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("u")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
