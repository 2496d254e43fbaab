"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store

MAX_ROUNDS = 60


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the least node of its component.

    edges is (a, b) of one orderable type; loops, repeats and rows with a null end are ignored. Each round hangs every
    node on the least node in sight, so the longest chain shrinks by half or more; rounds end when nothing moves. Minima are
    combined before they are shuffled, and a hub's links are an ordinary skewed join. Written tables cut the lineage.
    """
    e = store(edges.where(F.col(a) != F.col(b))
              .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = mark
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .where("hi != lo").distinct())
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(first, "hi").select(F.explode(F.array(
            F.struct("hi", "m"), F.struct(F.col("lo").alias("hi"), "m"))).alias("x"))
            .select("x.hi", F.col("x.m").alias("lo")).where("hi != lo").distinct())
        e = store(small, "edges")
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
