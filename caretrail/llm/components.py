"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import dropped, saved, unshuffled


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(a, b): the smallest node it reaches.

    Alternates two steps until nothing changes, O(log**2) rounds: each node hands its
    larger neighbours, then its smaller ones, to the smallest. Every round is an
    aggregation and a join on narrow rows, and is written to the shared folder. Null
    ends and loops are dropped.
    """
    now = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    last = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u > v").distinct()
        before, now = now, saved(small, "links")
        dropped(before)
        with unshuffled(now.sparkSession):
            sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == last:
            break
        last = sums
    top = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
