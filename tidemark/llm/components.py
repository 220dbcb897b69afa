"""Connected components of links that never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 60


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """For each node of edges (a, b), long: its component's smallest node. Columns node and comp.

    Alternates two steps until nothing changes. *Large star*: every node points its larger neighbours to its smallest
    one. *Small star*: every node points its smaller neighbours and itself to the smallest of them. What remains is a
    star around each component's smallest node. A node's minimum is combined before the shuffle and joined back, so a
    node with very many neighbours is a skewed join, not a group in one task.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = scratch.write(links, f"{name}-0")
    before = None
    for step in range(1, ROUNDS + 1):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written first: only a join of two plain tables is split where a node is hot.
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        least = scratch.write(least, f"{name}-{step}-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, f"{name}-{step}-large")
        smallest = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-smallest")
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = scratch.write(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-least", f"{name}-{step}-large", f"{name}-{step}-smallest")
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
