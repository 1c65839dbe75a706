"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the distinct word windows of the benchmark items. A shift table, indexed by the hash of a block of two
words, tells how far the search may skip; where it may not, the block's bucket lists the patterns that end in it, and a
direct comparison of the words confirms an occurrence. Many text segments advance together, one probe each a step.

Spark cuts the items into windows, unites equal ones and deals them into blocks by hash, of PATTERN_BLOCK windows on
average. The blocks come one after the other: a block is broadcast, all documents are searched, the hits are written, and
the broadcast is released, so workers and driver hold one block, about 200 bytes a window, however large the benchmark
is. Which items a window belongs to stays a table, which is joined with the distinct sets of windows that documents hit.

Defined cases: null text has no words; an item without words is never found, one shorter than the window is one
window of its length; repeated items count once each by id; words in windows of items with null id are hit, but such
items are not counted or listed; repeated rows get equal rows; rows that share an id are judged by their own text; an
empty benchmark leaves all documents clean; an empty document table gives no rows. Columns other than ids and texts are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, keep_rows, map_batches, materialize, spread_join, text_slices

#: Windows of a block, on average; a block that chance makes twice as large is cut again.
PATTERN_BLOCK = 200_000
#: Words of a text segment; segments advance in lockstep.
SEGMENT = 512

_WINDOWS = "item string, m int, said binary"
_HITS = "row1 long, row2 long, doc_id long, n_words long, spans array<struct<start:int,length:int>>, windows array<long>"


class WuManber:
    """Patterns of one length m over words: block shift table, suffix buckets, word-by-word comparison.

    patterns: words joined by one space; numbers: what an occurrence is reported as.
    """

    def __init__(self, m: int, patterns: list[bytes], numbers: np.ndarray):
        self.m, self.numbers = m, numbers
        self.text, self.at = b"".join(patterns), np.concatenate([[0], np.cumsum([len(p) for p in patterns])])
        h = textvec.find_words(pa.array(patterns, pa.binary()), textvec.NOT_SPACE).hashes().reshape(len(patterns), m)
        self.block = min(2, m)
        blocks = h if self.block == 1 else h[:, :-1] * np.uint64(3) + h[:, 1:]
        self.bits = max(12, int(blocks.size * 8).bit_length())
        #: Words that a search may move on when the block at the window's end hashes here.
        self.shift = np.full(1 << self.bits, blocks.shape[1], np.uint8 if m < 250 else np.int32)
        for j in range(blocks.shape[1]):
            at = self.slot(blocks[:, j])
            self.shift[at] = np.minimum(self.shift[at], blocks.shape[1] - 1 - j)
        #: Buckets: patterns in order of the block that they end in.
        self.order = np.argsort(blocks[:, -1], kind="stable").astype(np.int32)
        self.suffixes = blocks[self.order, -1]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (textvec.mix(blocks) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: textvec.Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(index of the first word, number of the pattern) of each occurrence inside one text."""
        m, first = self.m, words.first
        starts = np.concatenate([np.arange(a, b - m + 1, SEGMENT) for a, b in zip(first[:-1], first[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        if not len(starts):
            return
        text_end = first[np.searchsorted(first, starts, "right")]
        stop = np.minimum(starts + SEGMENT + m - 1, text_end)  # a segment's windows end before this
        at = starts + m - 1
        blocks = h if self.block == 1 else np.concatenate([h[:1], h[:-1] * np.uint64(3) + h[1:]])
        while len(at):
            move = self.shift[self.slot(blocks[at])].astype(np.int64)
            ends = at[move == 0]
            low, high = (np.searchsorted(self.suffixes, blocks[ends], side) for side in ("left", "right"))
            for end, a, b in zip(ends[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                said = b" ".join(words.text(end - m + 1 + j) for j in range(m))
                for i in self.order[a:b].tolist():
                    if self.text[self.at[i] : self.at[i + 1]] == said:
                        yield end - m + 1, int(self.numbers[i])
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, m, said for the distinct windows of each item: their number of words, and the words joined by one space."""
    schema = arrow_schema(_WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = textvec.find_words(batch.column("text"), textvec.ALNUM, lower=True)
            items, sizes, said = [], [], []
            for i, item in enumerate(batch.column("item").to_pylist()):
                own = [words.text(j) for j in range(words.first[i], words.first[i + 1])]
                found = {b" ".join(own[j : j + window]) for j in range(max(1, len(own) - window + 1) if own else 0)}
                said += found
                items += [item] * len(found)
                sizes += [min(len(own), window)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((items, sizes, said), schema, strict=True)], schema=schema)

    return map_batches(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")), run, _WINDOWS)


def numbered_windows(owned: DataFrame) -> DataFrame:
    """number, m, said of the distinct windows, stored."""
    return materialize(owned.select("m", "said").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")


def window_blocks(windows: DataFrame) -> Iterator[list[WuManber]]:
    """The windows of one block after the other, as engines by length; without a window, no block."""
    place = F.xxhash64("m", "said")
    total = windows.count()
    parts = -(-total // PATTERN_BLOCK)
    todo = [(parts, i) for i in reversed(range(parts))]
    while todo:
        parts, i = todo.pop()
        block = windows.where(F.pmod(place, F.lit(parts)) == i)
        if block.count() > 2 * PATTERN_BLOCK:
            todo += [(2 * parts, i + parts), (2 * parts, i)]
            continue
        rows = block.select("number", "m", "said").toArrow()  # at most 2 * PATTERN_BLOCK windows
        numbers, sizes, said = rows["number"].to_numpy(), rows["m"].to_numpy(), rows["said"].to_pylist()
        yield [WuManber(int(m), [said[j] for j in np.flatnonzero(sizes == m)], numbers[sizes == m]) for m in np.unique(sizes)]


def _occurrences(engines: list[WuManber], texts: pa.Array) -> tuple[textvec.Words, dict[int, list[tuple[int, int, int]]]]:
    """(words, (start, length, number) of the occurrences in each text that has any)."""
    words = textvec.find_words(texts, textvec.ALNUM, lower=True)
    h, found = words.hashes(), {}
    for engine in engines:
        for at, number in engine.search(words, h):
            doc = int(np.searchsorted(words.first, at, "right")) - 1
            found.setdefault(doc, []).append((at - int(words.first[doc]), engine.m, number))
    return words, found


def united_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) of the stretches that spans (start, length) cover."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b - a) for a, b in out]


def _hits(engines: Broadcast | None, every_row: bool):
    """Rows that are hit, or every row, with their covered stretches and the windows that occur."""
    schema = arrow_schema(_HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words, found = _occurrences(engines.value if engines else [], batch.column("text"))
            rows = list(range(batch.num_rows)) if every_row else sorted(found)
            spans = [[{"start": a, "length": n} for a, n in united_spans([x[:2] for x in found.get(i, ())])] for i in rows]
            numbers = [sorted({x[2] for x in found.get(i, ())}) for i in rows]
            keys = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("row1", "row2", "doc_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(words.counts()[rows], pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(numbers, schema.field("windows").type)], schema=schema)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per document."""
    context = docs.sparkSession.sparkContext
    text, own_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    # Rows go by two hashes of id and text from block to block: rows that are alike have the same hits.
    row = [F.xxhash64(own_id, text).alias("row1"), F.xxhash64(F.lit("row"), text, own_id).alias("row2")]
    source = docs.select(*row, own_id.alias("doc_id"), text.alias("text"))
    owned = materialize(item_windows(benchmark, item_col, item_text_col, window), "item-windows")
    windows = numbered_windows(owned)
    base, more = None, None
    for engines in window_blocks(windows):
        shared = context.broadcast(engines)
        part = materialize(map_batches(source, _hits(shared, base is None), _HITS), "block-hits")
        shared.destroy()
        if base is None:
            base = part
        else:
            more = part if more is None else more.unionByName(part)
    if base is None:
        base = materialize(map_batches(source, _hits(None, True), _HITS), "block-hits")
    clean = base.select("row1", "row2", "doc_id", "n_words")
    hits = base.select("row1", "row2", "spans", "windows")
    if more is not None:
        hits = hits.unionByName(more.select("row1", "row2", "spans", "windows"))
    united = hits.where("size(spans) > 0").groupBy("row1", "row2").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("windows"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["start"] + s["length"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(acc["end"], s["start"]))).cast("long").alias("n")),
        lambda acc: acc["n"],
    )
    united = materialize(united.select("row1", "row2", covered.alias("n_hit"), "windows"), "hit-rows")
    # Documents with the same windows have the same items: each set of windows is looked up once.
    sets = materialize(united.select("windows").distinct(), "window-sets")
    numbers = windows.join(owned, ["m", "said"]).where("item is not null").select("number", "item").distinct()
    listed = sets.select("windows", F.explode("windows").alias("number")).join(numbers, "number").groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = sets.join(listed, "windows", "left").select("windows", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    items = items.select("windows", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    verdicts = spread_join(united, items, ["windows"], F.col("row1")).select("row1", "row2", "n_hit", "n_items", "items_sha256")
    n_hit, n_items = (F.coalesce(c, F.lit(0)) for c in ("n_hit", "n_items"))
    return clean.join(verdicts, ["row1", "row2"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs without a window of any item, with all their columns."""
    context, shared = docs.sparkSession.sparkContext, None
    for engines in window_blocks(numbered_windows(item_windows(benchmark, item_col, item_text_col, window))):
        if shared is not None:  # what the block before leaves is written before the next is broadcast
            docs = materialize(docs, "block-clean")
            shared.destroy()
        shared = context.broadcast(engines)

        def clean(batch: pa.RecordBatch, shared: Broadcast = shared) -> np.ndarray:
            out = np.ones(batch.num_rows, bool)
            out[list(_occurrences(shared.value, batch.column(text_col))[1])] = False
            return out

        docs = keep_rows(docs, clean, text_col)
    return docs
