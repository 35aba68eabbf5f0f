"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, never null). node, root: the smallest node that it is linked with, for every node of an edge.

    Each round halves the depth of every tree; its edges are written to the shared folder, so lineage stays short and the
    driver sees a count and a checksum only. Self-loops are kept out; an empty table gives an empty result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: neighbours above a node go to the smallest node around it.
        large = both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.join(down, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = materialize(small, "cc")
        new = state(now)
        if new == last:
            break
        last = new
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
