"""Connected components of a link table, by alternating large-star and small-star steps. Links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.util import discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour (large: the larger ones; small: the smaller ones and the node) to the node's least neighbour."""
    if large:
        links = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "hi"))
        return links.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    ends = links.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return ends.unionByName(least.select("hi", F.col("m").alias("lo")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the least node reachable) for every node of links except the least ones themselves. Null ends and self links are dropped;
    repeats don't matter; no links give an empty table. Written."""
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = written(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi, lo).distinct())
    said = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_000_007)).first()
        if mark == said:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        said = mark
        then = written(_star(_star(now, True).distinct(), False).distinct())
        discard(now)
        now = then
