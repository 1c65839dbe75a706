"""Parsed files kept as a table: only files that changed are parsed, and only their partitions are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.storage import stored

#: Partitions of a cache; a path is always in the same one.
PARTITIONS = 64


def cached_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """What a cache holds, marks of emptied partitions included; None where there is none yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder)


def refresh(files: DataFrame, folder: str, version: int, parse: Callable[[DataFrame], DataFrame], partitions: int = PARTITIONS) -> DataFrame:
    """The rows of all files (path, mtime and what parse needs), after bringing the cache in folder up to date.

    parse gives rows with path for the files that it is given. Files with the time that the cache has for them are not
    parsed; rows of files that are gone are removed; rows of another version count as none. A partition in which nothing
    changed is not written: the others are overwritten as a whole, by dynamic partition overwrite, from a stored table,
    so a refresh that fails half-way is repeated with the same result. A file without rows is known by a row of its own
    with parsed = false, as is a partition whose files are all gone (with a null path).
    """
    spark = files.sparkSession
    bucket = F.pmod(F.xxhash64("path"), F.lit(partitions)).cast("int")
    now = files.withColumn("bucket", bucket)
    old = cached_rows(spark, folder)
    if old is None:
        stale, kept, touched = now, None, None
    else:
        known = old.where(F.col("path").isNotNull() & (F.col("cache_version") == version))
        seen = known.select("path", "mtime").distinct()
        current = now.join(seen, ["path", "mtime"], "left_semi").select("path", "mtime")
        stale = now.join(current, ["path", "mtime"], "left_anti")
        gone = old.where(F.col("path").isNotNull()).select("path", "mtime", "cache_version", "bucket").distinct().join(current.withColumn("cache_version", F.lit(version)), ["path", "mtime", "cache_version"], "left_anti")
        touched = stored(stale.select("bucket").unionByName(gone.select("bucket")).distinct(), "touched-partitions")
        kept = known.join(current, ["path", "mtime"], "left_semi").join(touched, "bucket", "left_semi")
    stale = stored(stale, "stale-files")
    own = ["path", "mtime", "bucket"]
    parsed = stale.select(*own).join(parse(stale.drop("bucket")).withColumn("parsed", F.lit(True)), "path", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False))).withColumn("cache_version", F.lit(version))
    rows = parsed if kept is None else kept.select(*parsed.columns).unionByName(parsed)
    rows = stored(rows, "cache-rows")
    if touched is not None:
        empty = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti")
        rows = rows.unionByName(empty.select("bucket", F.lit(False).alias("parsed"), F.lit(version).alias("cache_version")), allowMissingColumns=True)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).where("parsed").drop("bucket", "parsed", "cache_version", "mtime")
