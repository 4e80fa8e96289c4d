"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root), root the least node of the component; nodes without a link have no row.

    Every step is a grouped minimum and an equi-join, staged to the shared folder. The number of
    steps grows with the logarithm of the longest chain; it ends when each node has one link at most
    and no root has any. Self links and nulls are dropped.
    """
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        turned = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, now = now, staged(turned.where("a != b").distinct(), "cc")
        discard(before)
        ends = now.select("a", F.lit(1)).union(now.select("b", F.lit(0)).distinct()).toDF("node", "links")
        ends = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("links").alias("links"))
        if not ends.agg(F.count_if(F.expr("links > 0 and n > 1"))).first()[0]:
            break
    return now.toDF("node", "root").union(now.select("b", "b").distinct())
