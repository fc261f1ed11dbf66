"""Connected components of a graph of links, by the smallest reachable id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reportlake.llm.common import drop, save


def _noted(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells them from others: their number and a sum of hashes, noted as they are written."""
    seen = Observation()
    out = save(spark, edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return out, (seen.get["n"], seen.get["h"])


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id and component of every id in links(a, b); component is the smallest id that links lead to.

    Alternates large-star and small-star steps until nothing changes, however
    many that takes (about the logarithm of the longest path): each step keeps
    at most a row a link and is written to the shared folder. Links from an id
    to itself and nulls are ignored.
    """
    edges, was = _noted(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # large-star: the larger neighbours of a go to the smallest of a's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("n")).join(least, "a").select(F.col("n").alias("a"), F.col("m").alias("b"))
        large = save(spark, large, "large")
        # small-star: the smaller neighbours of a, and a, go to the smallest of them
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lows.select("a", F.col("m").alias("b")))
        after, now = _noted(spark, small.where("a <> b").distinct())
        drop(spark, edges, large)
        edges = after
        if now == was:
            break
        was = now
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(edges.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component")))
