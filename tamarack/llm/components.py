"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each round is a step of either kind and is written to the shared folder, so lineage stays short. The number of rounds
grows with the logarithm of the longest path. A node's smallest neighbour is joined by (node, salt), so a node with very
many edges is spread over SALTS tasks; while all edges are at most FEW rows, it is broadcast instead.

Defined cases: a node without an edge to another has no row; loops and repeated edges change nothing; edges with a null
end are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_parts, staged

SALTS, FEW = 16, 100_000


def _with_smallest(edges: DataFrame, few: bool) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if few:
        return edges.join(F.broadcast(least), "u").select("u", "v", "m")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has an edge to another."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now, before = staged(now, "edges"), None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if sign == before or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        before, few = sign, 2 * sign[0] <= FEW
        both = now.union(now.select("v", "u"))
        large = _with_smallest(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = _with_smallest(large, few)
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v > m").select("v", "m"))
        now = staged(few_parts(small.filter("u > v").distinct(), sign[0]), "stars")
