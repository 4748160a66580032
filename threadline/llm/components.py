"""Distributed connected components by alternating large and small stars.

Edges stay in Spark all the time.  A round joins every edge with the least
neighbour of its end (one row a node, partially aggregated) and writes the
edges to the shared folder, which cuts the lineage.  Every component ends as a
star around its least node; the number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large star: hang every greater neighbour on the
    least one; small star: hang the node and its smaller neighbours on it."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # the greater neighbours b of a: edges stored as (greater, a)
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("v"))
        out = up.join(least, "a").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        j = edges.join(least, "a")
        out = j.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for every node of an edge the least node it can reach.
    edges (a, b) of any order; loops and repeats don't matter."""
    cur = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        seen = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state or not seen.n:
            break
        state = (seen.n, seen.h)
        cur = materialize(_star(_star(cur, True), False), name)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
