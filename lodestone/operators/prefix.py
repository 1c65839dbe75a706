"""Running sums and maxima by key that no task has to compute alone, however many rows a key has."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import stored


def _unused(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Rows of one key that one task may hold in a window; the ranges below are for keys that have more.
MOST_IN_WINDOW = 1 << 20


def has_hot_key(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key has more rows than a window should hold."""
    largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) > MOST_IN_WINDOW


def prefix_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows and, for each name in values, the sum of that value over the rows of the same keys that come before."""
    return _before(rows, keys, order, {name: F.coalesce(v.cast("long"), F.lit(0)) for name, v in values.items()}, F.sum, 0, partitions)


def prefix_maxima(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """The same for the greatest value, which is null where no row comes before."""
    return _before(rows, keys, order, values, F.max, None, partitions)


def _before(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], total: Callable, nothing: int | None, partitions: int | None) -> DataFrame:
    """rows and, for each name in values, the total of that value over the rows of the same keys that come before.

    Rows are dealt by ranges of (keys, order), so a hot key has many tasks. What a key sums to at the end of one range
    is carried to the next ones that the key reaches into: one row for each range, which is all that is broadcast.
    Null keys are a key of their own and null orders come first; the place of rows with equal order is not fixed. rows are read twice (once to find the ranges), so they should be stored or cheap.
    """
    spark = rows.sparkSession
    partitions = partitions or max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part, first, last = (_unused(rows, c) for c in ("part", "first_key", "last_key"))
    carried = {name: _unused(rows, f"carried_{name}") for name in values}
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0))
    columns = rows.columns
    amounts = {name: _unused(rows, f"amount_{name}") for name in values}
    valued = rows.select("*", *(v.alias(amounts[name]) for name, v in values.items()))
    dealt = valued.repartitionByRange(partitions, *keys, *order)
    ranged = stored(dealt.withColumn(part, F.spark_partition_id()), "prefix-ranges")

    edges = ranged.groupBy(part).agg(F.min(key).alias(first), F.max(key).alias(last))
    at_end = {name: total(F.when(key.eqNullSafe(F.col(last)), F.col(amounts[name])).otherwise(nothing)).alias(carried[name]) for name in values}
    tails = ranged.join(F.broadcast(edges), part).groupBy(part).agg(*at_end.values()).join(edges, part)
    # From here on one row for each range.
    along, so_far = Window.orderBy(part), Window.partitionBy(last).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    running = tails.select(part, first, last, *(total(c).over(so_far).alias(c) for c in carried.values()))
    reaches = F.col(first).eqNullSafe(F.lag(last).over(along)) & F.lag(part).over(along).isNotNull()
    bases = running.select(part, first, *(F.when(reaches, F.lag(c).over(along)).otherwise(nothing).alias(c) for c in carried.values()))

    before = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = {name: total(amounts[name]).over(before) for name in values}
    based = {name: F.when(key.eqNullSafe(F.col(first)), F.col(carried[name])).otherwise(nothing) for name in values}
    both = {name: F.greatest(inside[name], based[name]) if nothing is None else F.coalesce(inside[name], F.lit(nothing)) + based[name] for name in values}
    return ranged.join(F.broadcast(bases), part).select(*columns, *(both[name].alias(name) for name in values))
