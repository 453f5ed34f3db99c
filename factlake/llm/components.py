"""Connected components of a link table, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stash


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b), b < a: each node points its larger (or smaller) neighbours at the least of all."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node. Self-links and repeated
    links do not matter; no links give an empty table. Rounds go on until one changes nothing."""
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pairs, before = stash(pairs, "links"), None
    while True:
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == before:
            break
        before = (row["n"], row["h"])
        old, pairs = pairs, stash(_star(_star(pairs, True), False), "links")
        forget(old)
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
