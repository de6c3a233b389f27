"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeflow.tables import materialise


def connected(edges: DataFrame) -> DataFrame | None:
    """v, root for every vertex of the edges (a, b), or None without edges: randomised contraction. In each round a
    vertex joins the least vertex of its closed neighbourhood, by id at first and then by a hash that changes with the
    round, and edges inside a joined group vanish; the rounds grow with the logarithm of the vertices, however long
    a path is. Both sides of every join are tables, so that Spark splits the partition of a vertex with very many edges."""
    current = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not current.isEmpty():
        k = len(steps)
        rank = (lambda c: F.col(c)) if k < 2 else (lambda c, k=k: F.xxhash64(F.lit(k), F.col(c)))
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("v"))).alias("least"))
        parent = materialise(least.select(F.col("a").alias("v"), F.when(F.col("least.rank") < rank("a"), F.col("least.v")).otherwise(F.col("a")).alias("p")), "parents")
        ends = current.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        current = materialise(ends.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        steps.append(parent)
    if not steps:
        return None
    roots = steps[0].select("v", F.col("p").alias("root"))
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
    return roots
