"""Graphs as edge tables: bounded reverse reachability, impact roll-up, degrees, reference resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import stored

#: Why a node is hit when a value that it uses changes.
USES_VALUE = "uses return value"


def reverse_reach(edges: DataFrame, seeds: DataFrame, max_depth: int, source: str = "source", target: str = "target") -> DataFrame:
    """node, depth: what leads to a seed over at most max_depth edges, at its least depth; seeds are not revisited.

    seeds: one column, node. Each level joins a frontier without repeats, and only new nodes go on. Edges and levels are
    stored, so a level is computed once, from tables alone.
    """
    callers = stored(edges.select(F.col(target).alias("node"), F.col(source).alias("caller")).distinct(), "callers")
    seen = frontier = stored(seeds.select("node", F.lit(0).alias("depth")).distinct(), "seeds")
    for depth in range(1, max_depth + 1):
        frontier = frontier.join(callers, "node").select(F.col("caller").alias("node")).distinct().join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"))
        # The last level is read once, by whoever reads the result.
        frontier = stored(frontier, "level") if depth < max_depth else frontier
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def impacts(adds: DataFrame, node: str, stage: str, reason: str, depth: str, attributes: str) -> DataFrame:
    """One row for each node: the first reason by stage, the least depth, all attributes; a node added more than once
    that uses attributes is hit by the value."""
    rows = adds.groupBy(node).agg(
        F.min_by(reason, stage).alias("_first"),
        F.min(depth).alias(depth),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(attributes)))).alias(attributes),
        F.count(F.lit(1)).alias("_adds"),
    )
    return rows.select(node, depth, F.when((F.col("_adds") > 1) & (F.size(attributes) > 0), USES_VALUE).otherwise(F.col("_first")).alias(reason), attributes)


def degrees(nodes: DataFrame, edges: DataFrame, node: str, source: str = "source", target: str = "target") -> DataFrame:
    """node, degree over edges whose both ends are nodes; zero-filled, a loop counts twice."""
    ids = nodes.select(node)
    visible = edges.join(ids.withColumnRenamed(node, source), source, "left_semi").join(ids.withColumnRenamed(node, target), target, "left_semi")
    ends = visible.select(F.col(source).alias(node)).unionByName(visible.select(F.col(target).alias(node)))
    return ids.join(ends.groupBy(node).agg(F.count(F.lit(1)).alias("degree")), node, "left").select(node, F.coalesce("degree", F.lit(0)).alias("degree"))


def resolve_references(refs: DataFrame, definitions: DataFrame, symbol: str, ref_key: Sequence[str], file: str, target: str, own: str | None = None) -> DataFrame:
    """refs with the best definition of their symbol: one in their file first, then the least target; never the one
    that own (a column of refs) names. refs and definitions both have the columns symbol and file.

    Only the least definitions of a symbol, and of it in a file, can be picked: one, or two where own may be the first.
    A reference meets no others, however often its symbol is defined.
    """

    def least(*keys: str) -> DataFrame:
        if own is None:
            return definitions.groupBy(*keys).agg(F.min(target).alias(target))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(target))
        return definitions.select(*keys, target).where(F.col(target).isNotNull()).distinct().withColumn("_place", place).where("_place <= 2").drop("_place")

    there = refs.join(least(symbol, file), [symbol, file]).withColumn("_other", F.lit(0))
    anywhere = refs.join(least(symbol), symbol).withColumn("_other", F.lit(1))
    found = there.unionByName(anywhere)
    found = found if own is None else found.where(F.col(own) != F.col(target))
    return found.groupBy(*ref_key).agg(F.min_by(target, F.struct("_other", target)).alias(target))


def consecutive_edges(df: DataFrame, group: Sequence[str], order: Sequence[str], node: str) -> DataFrame:
    """Distinct source, target of consecutive rows of a group."""
    following = F.lead(node).over(Window.partitionBy(*group).orderBy(*order))
    return df.select(F.col(node).alias("source"), following.alias("target")).where("target is not null").distinct()
