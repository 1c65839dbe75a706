"""Intervals: islands of overlapping ones, and the innermost one around a point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.prefix import has_hot_key, prefix_maxima, prefix_sums
from lodestone.sources.storage import stored


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """keys, start, end, members of the islands: intervals that overlap or share an end belong together.

    Where a key has more rows than a window should hold, both running values go by ranges of rows instead.
    """
    rows = df.select(*keys, start, end)
    if has_hot_key(rows, keys):
        rows = stored(prefix_maxima(stored(rows, "intervals"), keys, [start, end], {"_reach": F.col(end)}), "interval-reach")
        opened = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0))
        # A row's island is known by how many begin up to it.
        numbered = prefix_sums(opened, keys, [start, end, "_reach"], {"_before": F.col("_new")}).withColumn("_island", F.col("_before") + F.col("_new"))
    else:
        order = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        opened = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
        numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_island")


def _level(length: Column) -> Column:
    """The power of two that a length does not exceed."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def stabbed(points: DataFrame, point: Column, spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """points joined with every span of their keys that holds the point (start <= point <= end), as columns of both.

    A span lies in the bins of one level, whose width is the next power of two above its length, so in two bins at most
    however long it is; a point looks once in each level that there is. All are whole numbers.
    """
    length = F.col(end) - F.col(start) + 1
    levelled = spans.where(length > 0).withColumn("_level", _level(length))
    width = F.pow(F.lit(2.0), F.col("_level"))
    bins = F.array_distinct(F.array(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    held = levelled.withColumn("_bin", F.explode(bins))
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())  # 64 numbers at most
    looks = F.array(*(F.struct(F.lit(x).alias("_level"), F.floor(F.col("_point") / F.lit(2.0**x)).alias("_bin")) for x in levels)) if levels else F.array().cast("array<struct<_level:int,_bin:bigint>>")
    placed = points.withColumn("_point", point.cast("long")).withColumn("_look", F.explode(looks))
    looking = placed.select(*points.columns, "_point", "_look.*")
    return looking.join(held, [*keys, "_level", "_bin"]).where((F.col(start) <= F.col("_point")) & (F.col("_point") <= F.col(end))).drop("_level", "_bin")


def innermost(points: DataFrame, point: Column, spans: DataFrame, keys: Sequence[str], start: str, end: str, point_key: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """points with the shortest span of their keys that holds the point (start <= point <= end)."""
    best = F.struct((F.col(end) - F.col(start)).alias("_span"), *ties)
    return stabbed(points, point, spans, keys, start, end).groupBy(*point_key).agg(F.min_by(F.struct(start, end), best).alias("_s")).select(*point_key, F.col(f"_s.{start}"), F.col(f"_s.{end}"))
