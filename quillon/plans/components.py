"""Connected components by alternating stars, without gathering links.

Rounds of the large-star and small-star steps turn any set of links into one
star for each component. Each step is an aggregation with map-side combining and
an equi-join whose skew adaptive execution splits; each round is written to the
shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.staging import stage, unstage


def _large(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.distinct()


def _small(links: DataFrame) -> DataFrame:
    """Links have u > v; the smaller neighbours and u itself go to the smallest."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    out = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (u, v)`` but the roots themselves.

    The root is the smallest node of the component. Links may repeat and point
    either way; links of a node to itself are left out.
    """
    tidy = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, seen = stage(tidy, "links"), None
    while True:
        after = stage(_small(_large(current)), "stars")
        row = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        unstage(current)
        current = after
        if (row.n, row.x) == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = (row.n, row.x)
