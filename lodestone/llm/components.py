"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every u has one v, which is smaller and no u itself: the components are found."""
    counts = edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.count_if(F.col("u") < F.col("v"))).first()
    if counts[0] != counts[1] or counts[2]:
        return False
    return not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of an edge u, v of long; self-edges say nothing.

    Each round is written to the shared folder, so lineage stays short; the number of rounds grows with the
    logarithm of the number of nodes. Hubs are pre-aggregated, and what is joined to a hub is one row.
    """
    now = materialize(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while not _is_stars(now):
        now = materialize(_small_star(_large_star(now)), "stars")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
