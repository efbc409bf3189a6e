"""Connected components by alternating large-star and small-star steps on an edge table.

Every step is an aggregation with partial sums and an equi-join; nothing is gathered on the driver but a checksum, and
no node's neighbours are collected. Tables of a step are written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """(a, b) with a > b: each node's larger (or, for ``small``, smaller) neighbours are linked to its least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("a", "least"))
    out = both.join(least, "a")
    if small:
        out = out.select(F.col("b").alias("x"), "least").unionByName(least.select(F.col("a").alias("x"), "least"))
    else:
        out = out.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "least")
    return out.filter(F.col("x") != F.col("least")).select(F.col("x").alias("a"), F.col("least").alias("b")).distinct()


def components(s: Scratch, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of an edge (a, b); the root is the least node of the component, with itself as root."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = s.table(edges.filter(F.col("a") != F.col("b")).select(a, b).distinct(), tidy=True)
    before = None
    for _ in range(rounds):
        edges = s.table(_star(_star(edges, small=False), small=True))
        h = F.xxhash64("a", "b")
        now = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFF)), F.sum(F.shiftright(h, 28).bitwiseAND(0xFFFFFFF))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", F.col("b").alias("r")).distinct().toDF("node", "root"))
        before = now
    raise RuntimeError("components did not settle")
