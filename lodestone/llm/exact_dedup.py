"""Exact deduplication by content-defined chunk recipes.

A text is cut where a hash of its last eight bytes says so. Each chunk gets a 64-bit identifier, verified against
128 bits of SHA-256 over all chunks of the input; a text is then its ordered list of identifiers, and only those
short lists are shuffled, grouped and joined. Texts stay where they are read. A group of copies is counted with a partial
aggregate and joined back in as many tasks as its rows have salts, so a third of all rows may be equal.

Defined cases: null text counts as empty, and all empty texts are equal; rows repeating both id and text count in
group_size and share one verdict; a null id is kept only where no other row has the text; an empty table gives no
rows. Columns other than id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, map_batches, materialize, spread_join, text_slices, with_row_key

#: A cut after 1 of 2**CUT_BITS positions, chunks of MIN_CHUNK to MAX_CHUNK bytes.
CUT_BITS, MIN_CHUNK, MAX_CHUNK = 11, 256, 16384

_ROWS = "row_key long, doc_id long, text_sha256 string, n_bytes long, chunks array<struct<fp:long,d1:long,d2:long>>"


def chunk_ends(data: np.ndarray, off: np.ndarray) -> Iterator[list[int]]:
    """Ends of the chunks of each text, as offsets into data (which has 8 zero bytes behind)."""
    at8 = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    hot = np.flatnonzero((at8 * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CUT_BITS) == 0) + 8
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        out, last = [], lo
        for cut in hot[np.searchsorted(hot, lo + MIN_CHUNK) : np.searchsorted(hot, hi)].tolist():
            if cut - last < MIN_CHUNK:
                continue
            while cut - last > MAX_CHUNK:
                last += MAX_CHUNK
                out.append(last)
            if cut > last:
                out.append(last := cut)
        while hi - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if hi > last:
            out.append(hi)
        yield out


def _recipes(fingerprint: Callable[[bytes], int]):
    schema = arrow_schema(_ROWS)
    signed = lambda values: np.array(values, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            data, off = textvec.utf8(batch.column("text"))
            fps, d1, d2, counts, shas = [], [], [], [0], []
            for lo, hi, ends in zip(off[:-1].tolist(), off[1:].tolist(), chunk_ends(data, off), strict=True):
                shas.append(hashlib.sha256(data[lo:hi]).hexdigest())
                for end in ends:
                    piece = data[lo:end].tobytes()
                    strong = hashlib.sha256(piece).digest()
                    fps.append(fingerprint(piece) & ((1 << 64) - 1))
                    d1.append(int.from_bytes(strong[:8], "big"))
                    d2.append(int.from_bytes(strong[8:16], "big"))
                    lo = end
                counts.append(len(fps))
            chunks = pa.StructArray.from_arrays([pa.array(signed(x)) for x in (fps, d1, d2)], fields=list(schema.field("chunks").type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), pa.array(shas, pa.string()), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), chunks, type=schema.field("chunks").type)], schema=schema
            )

    return run


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, row_key: str | None = None) -> DataFrame:
    """row_key, doc_id, text_sha256, recipe array<long> per row, stored: equal recipes if and only if equal texts.

    The recipe starts with the text's length. A fingerprint that stands for two different chunks anywhere in the
    input is not verified; texts with such a chunk spell out the strong digests instead. row_key names a column that
    is a key; without one, rows are numbered.
    """
    key = F.monotonically_increasing_id() if row_key is None else F.col(row_key)
    source = docs.select(key.alias("row_key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(map_batches(source, _recipes(fingerprint), _ROWS), "recipes")
    chunk = rows.select("row_key", F.explode("chunks").alias("c")).select("row_key", "c.*")
    unverified = materialize(
        chunk.groupBy("fp")
        .agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("d1", "d2") for f in (F.min, F.max)))
        .where("min_d1 <> max_d1 or min_d2 <> max_d2")
        .select("fp"),
        "unverified",
    )
    size, plain = F.array("n_bytes"), F.concat(F.array("n_bytes"), F.col("chunks.fp"))
    if unverified.isEmpty():  # as a rule; else a common chunk's rows are dealt over many tasks
        return rows.select("row_key", "doc_id", "text_sha256", plain.alias("recipe"))
    spelled = spread_join(chunk.select("row_key", "fp"), unverified, ["fp"], F.xxhash64("row_key"), "left_semi").select("row_key").distinct().withColumn("spelled", F.lit(True))
    strong = F.concat(size, F.flatten(F.transform("chunks", lambda c: F.array(c["fp"], c["d1"], c["d2"]))))
    return materialize(rows.join(spelled, "row_key", "left").select("row_key", "doc_id", "text_sha256", F.when(F.col("spelled"), strong).otherwise(plain).alias("recipe")), "spelled-recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    rows = recipes(docs, id_col, text_col, **options)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return spread_join(rows, groups, ["recipe"], F.xxhash64("row_key")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row, that of the largest id.

    Of rows that also share the id the first read stays; a null id is smaller than any other.
    """
    keyed, key = with_row_key(docs, "rows-to-unite")
    rows = recipes(keyed, id_col, text_col, row_key=key)
    best = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", (-F.col("row_key")).alias("k"))).alias("best"))
    return keyed.join(best.select((-F.col("best.k")).alias(key)), key, "left_semi").select(docs.columns)
