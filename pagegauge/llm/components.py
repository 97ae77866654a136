"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b: long).

    Large-star and small-star steps by turns: each node hands its smallest neighbour to its larger ones, then to its
    smaller ones. Minima are combined before each shuffle, and no step lists a node's neighbours, so a node with very
    many links is no hot spot. Links to itself make a node its own component. Every step's table is written to the
    shared folder.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct(), "links")
    before = None
    while True:
        # Large-star: both directions; larger neighbours go to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        old, large = edges, saved(large.unionByName(edges.where("u = v")), "large")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(old, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = saved(stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")), "components")
    discard(edges)
    return found
