"""Plumbing that the operators share: shipping the package, shared storage, Arrow maps, fixed-size id filters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.sources.storage import shared_folder

#: Bytes of text that one vectorised step works on; it bounds a Python worker's memory.
SLICE_BYTES = 2 << 20

_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}
_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _SHIPPED[context.applicationId] = target


def materialize(df: DataFrame, tag: str, **options: str | int) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors take nothing along.

    options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    # What was shuffled for the table is of no use once it is written; small Arrow batches spare the workers' memory.
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote. Call it only when all that was made of them is written itself."""
    for df in tables:
        spark = df.sparkSession
        own = f"/{spark.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores before it until no column of df has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_row_key(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """(df with a key for each row, written so that the keys stay; the key's name). Repeated rows get keys of their own."""
    name = free_name(df, "row_key")
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), tag), name


def salts(spark: SparkSession) -> int:
    """Parts that the rows of one hot key are dealt into: as many as a shuffle has partitions, 16 at least."""
    return max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], salt: Column, how: str = "inner") -> DataFrame:
    """rows joined with small, which has a key once; rows of one key meet in as many tasks as they have salts.

    small is brought only to those (key, salt) pairs that rows have, so it never grows beyond the rows. `how` is inner
    or left_semi. rows are read twice and should be stored. Keys are not null.
    """
    name = free_name(rows, "salt")
    salted = rows.withColumn(name, F.pmod(salt, F.lit(salts(rows.sparkSession))).cast("int"))
    pairs = salted.select(*keys, name).distinct().join(small, keys)
    return salted.join(pairs, [*keys, name], how).drop(name)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with the package shipped."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray], text_col: str, limit: int = SLICE_BYTES) -> DataFrame:
    """The whole rows for which mask, given slices of them, is true. No row leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col, limit):
            yield batch.filter(pa.array(mask(batch), pa.bool_()))

    return map_batches(df, run, df.schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(ddl))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about `limit` bytes of text, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        ends = np.cumsum(string_lengths(batch.column(column)))
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def string_lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_filter(df: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A bitmap of 2**bits hashed ids (0.5 MB at 22 bits, whatever the input): false positives only.

    Built by Spark's bitmap aggregates, so that what reaches the driver has a fixed bound. Workers use it
    to leave out rows early; an exact join has to follow.
    """
    position = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << bits))
    rows = (
        df.select(position.alias("p"))
        .groupBy(F.bitmap_bucket_number(F.col("p")).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p"))).alias("map"))
        .collect()
    )
    # Buckets are numbered from 1 with 32768 positions each; position 0 falls in bucket 0 or 1 by sign rules.
    out = np.zeros((1 << bits) // 8 + 2 * 4096, np.uint8)
    for r in rows:
        at = r["bucket"] * 4096
        out[at : at + len(r["map"])] |= np.frombuffer(bytes(r["map"]), np.uint8)
    return out


def filter_position(column: Column, bits: int = 22) -> Column:
    """The byte and bit of id_filter's bitmap that an id falls on, as one long (byte * 8 + bit)."""
    p = F.pmod(F.xxhash64(column.cast("long")), F.lit(1 << bits))
    return F.bitmap_bucket_number(p) * F.lit(4096 * 8) + F.bitmap_bit_position(p)


def in_filter(bitmap: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bitmap[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 != 0
