"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantseek.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b long); the component is its smallest node.

    A round joins every edge with the smallest neighbour of one end, so no neighbour list is ever collected,
    and Spark can split the rows of a node with very many edges. Rounds go on until the edges stay the same;
    they are then stars around the smallest nodes.
    """
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        # large star: larger neighbours of u go to the smallest neighbour of u (or u itself)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
                 .where("u <> v").distinct())
        after = scratch.write(small)
        scratch.drop(now)
        now = after
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    return (stars.select(F.col("u").alias("node"), "component")
            .unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
