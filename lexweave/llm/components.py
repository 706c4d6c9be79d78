"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (its smallest id) of every node of ``edges``; nodes without edges don't appear.

    Each round hangs every node's larger neighbours under its smallest one, then
    its smaller neighbours too; edges never multiply, and the number of rounds
    grows with the logarithm of the longest path. Minima are taken before the
    shuffle and written, so that the joins with them have plain shuffles on both
    sides, of which adaptive execution parts a hub's edges among tasks. Each round
    is checkpointed; only counts come to the driver. Edges with a null end are
    left out.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y")).where("_x is not null and _y is not null and a <> b").select("a", "b").distinct()
    e, before = cut(e), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
