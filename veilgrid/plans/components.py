"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrid.plans.storage import drop_folder, shared_folder, stored


def _sum(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _least(edges: DataFrame) -> DataFrame:
    """Per u the smallest of u and its neighbours; only minima are grouped, so a hub's links never meet in one task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (u, v: bigint) -> (v, m): every node but a component's smallest, with that smallest.

    Repeated links, both directions and loops are allowed; null ends are left out; no links give no rows. Each round is
    written to the shared folder, so no round is computed twice and lost executors cost one round at most. The joins to a hub's
    minimum are plain equi-joins of 16-byte rows, which adaptive execution splits when skewed.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "components")
    tidy = lambda e: e.where("u > v").distinct()
    edges = stored(tidy(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")), "round0", folder)
    before, n = _sum(edges), 0
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        n += 1
        edges = stored(tidy(small), f"round{n}", folder)
        drop_folder(spark, f"{folder}/round{n - 1}")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("v"), F.col("v").alias("m"))
