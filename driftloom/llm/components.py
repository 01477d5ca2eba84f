"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stage


def _minima(pairs: DataFrame) -> DataFrame:
    """The least neighbour of each u, or u itself if that is less; staged, so that the join with it can split a hub."""
    return stage(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-minima")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that links (a, b) name: the least id that it reaches.

    Each pass shortens all paths to the least id; the number of passes grows with the logarithm of the longest path. It ends
    when the table is a forest of stars: one row per u, and no u among the v. Hubs are summed before the shuffle and split in
    the join; nothing is collected but two counts per pass.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stage(links.where("a <> b").select(a, b).distinct(), "links")
    while True:
        ends = edges.groupBy("u").agg(F.count("*").alias("n")).withColumn("below", F.lit(0)).unionByName(edges.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(1).alias("below")))
        open_ends = ends.groupBy("u").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).where("n > 1 or (n > 0 and below > 0)")
        if open_ends.isEmpty():
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        small = large.join(_minima(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "small-star")
