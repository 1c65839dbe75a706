"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are range-partitioned by id; each partition's total goes into a small table whose running sum gives the
partition its offset, and a row's offset is that plus the running sum inside its partition. Shard borders are equal
fractions of the total; a row goes where its middle byte falls. Only ids, sizes and checksums move.

Defined cases: null text has no bytes (size 16, checksum of nothing); rows with equal or null ids are ordered by
checksum and size, then by their place in the input; an empty table gives no rows; fewer rows than shards leave
shards empty. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, text_column

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


def byte_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    partitions = partitions or max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = text_column(docs, text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "text_crc32", "size", "place"]
    ranged = materialize(rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_base"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "total",
        (F.col("byte_base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("row_base") + F.row_number().over(inside) - 1).alias("row"),
    )
    shard = F.expr(f"least({n_shards - 1}, (start + size div 2) * {n_shards} div total)").cast("int")
    cut = materialize(placed.withColumn("shard", shard), "shard-rows")
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
