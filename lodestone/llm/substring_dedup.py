"""Removal of repeated passages with a log-structured fingerprint index.

The index grows by batches and keeps immutable runs. A run is a written table with a row for each hash range (bucket),
whose hashes are sorted; a batch meets the runs of its bucket in one task, which merges sorted arrays.

* anchor runs. Of the nine 5-word hashes in a 13-word window, the least is the window's anchor; equal windows have
  equal anchors. A run has each anchor with its first document and whether it has others: a fifth of the words.
* window runs. Each 13-word window whose anchor has been seen in two documents, with its first document. A window is
  known by two independent 64-bit hashes over separate hashes of its words: the first is the key, the second verifies
  it, and marks are made of both.

A batch's anchors are merged with the anchor runs. Where a batch meets an anchor that only one earlier document had,
that document's windows are added late, from its text. The batch's windows are then merged with the window runs, its
repeated words marked. A batch that finds more than MAX_RUNS runs first compacts them into one, and the tables that
this one stands for are deleted as soon as it is written. Hashes are united in each
task before they are shuffled, so a passage that a third of the documents have costs one entry a task.

Ids have to ascend from batch to batch: a document loses what a smaller id, in an earlier batch or its own, has.

Defined cases: null text has no words; texts shorter than the window lose nothing; rows that share an id count as one
document and get a row each; rows with null id lose nothing and take nothing; an empty batch gives no rows. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, discard, filter_position, id_filter, in_filter, map_batches, materialize, text_slices

#: Words of an anchor.
ANCHOR = 5
MAX_RUNS = 2
#: Text bytes whose hashes share a bucket; entries that a task gathers before it hands them on.
BUCKET_BYTES, FLUSH = 12 << 20, 1_000_000
#: Bits (as a power of 2) of the bitmap that spares documents: 0.5 MB, whatever the input. That of anchors has at
#: most 2**30 (128 MB).
DOC_BITS, MOST_ANCHOR_BITS = 22, 30

#: Kinds of block rows: entries of a batch, a run, marks of a part of the documents, a part of the anchor bitmaps, documents whose
#: windows come late.
FRESH, RUN, MARK, MAP, OWNER = range(5)
_BLOCKS = "bucket int, kind int, part int, keys binary, checks binary, docs binary"
_BLOCKS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("docs", pa.binary())])
_MARKED = "doc_id long, marked binary"
_SCANNED = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def window_anchors(words: textvec.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first word, anchor, word hashes) for all windows of the texts."""
    h = words.hashes()
    at = np.flatnonzero(textvec.window_starts(words.first, window))
    if not len(at):
        return at, np.zeros(0, np.uint64), h
    grams = textvec.window_hashes(h, ANCHOR, seed=3)
    least = grams[: len(grams) - (window - ANCHOR)].copy()
    for j in range(1, window - ANCHOR + 1):
        np.minimum(least, grams[j : j + len(least)], out=least)
    return at, textvec.mix(least[at]), h


def window_keys(words: textvec.Words, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window; the second goes back to hashes of the words' bytes of its own."""
    return textvec.window_hashes(h, window, 1), textvec.window_hashes(words.hashes(seed=7), window, 2)


def mark_of(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """What a document's marked window is known by inside that document, from both hashes."""
    return textvec.mix(keys + checks * np.uint64(0x9E3779B97F4A7C15))


def _doc_of(words: textvec.Words, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(words.first, at, "right") - 1]


def _top(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows of equal columns begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _spans(starts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), [*starts[1:].tolist(), n] if len(starts) else [], strict=True)


def _row(bucket: int, kind: int, keys: np.ndarray, checks: np.ndarray | None = None, docs: np.ndarray | None = None, part: int | None = None) -> tuple:
    return bucket, kind, part, keys.tobytes(), None if checks is None else checks.tobytes(), None if docs is None else docs.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_BLOCKS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS_ARROW, strict=True)], schema=_BLOCKS_ARROW)


def _spread(parts: Iterator[tuple[np.ndarray, ...]], bits: int, unite: Callable[..., tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """United entries (keys, checks, docs) as one row for each bucket."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        keys, checks, docs = unite(*(np.concatenate(c) for c in zip(*held, strict=True)))
        buckets = _top(keys, bits)
        return _batch([_row(int(buckets[a]), FRESH, keys[a:b], checks[a:b], docs[a:b]) for a, b in _spans(_starts(buckets), len(keys))])

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= FLUSH:
            yield flush(held)
            held, n = [], 0
    if held:
        yield flush(held)


def unite_anchors(keys: np.ndarray, last: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted anchors with their last and first document."""
    order = np.argsort(keys, kind="stable")
    keys, last, first = keys[order], last[order], first[order]
    at = _starts(keys)
    return (keys[at], np.maximum.reduceat(last, at), np.minimum.reduceat(first, at)) if len(at) else (keys, last, first)


def unite_windows(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct entries, sorted by window and document."""
    order = np.lexsort((docs, checks, keys))
    keys, checks, docs = keys[order], checks[order], docs[order]
    at = _starts(keys, checks, docs)
    return keys[at], checks[at], docs[at]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """Rows of one bucket after the other; the rows come sorted by bucket."""
    at, held = None, {}
    for batch in batches:
        for bucket, kind, keys, checks, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "checks", "docs")), strict=True):
            if bucket != at and held:
                yield at, held
                held = {}
            at = bucket
            held.setdefault(kind, []).append((keys, checks, docs))
    if held:
        yield at, held


def _arrays(rows: list[tuple], kinds: tuple = (np.uint64, np.uint64, np.int64)) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.frombuffer(r[i], kind) for r in rows]) if rows else np.zeros(0, kind) for i, kind in enumerate(kinds))


class SubstringIndex:
    """add(batch) returns a batch's result and takes it into the index. text_bytes: what the index is laid out for."""

    def __init__(self, spark: SparkSession, window: int = 13, text_bytes: int = 1 << 30):
        if window <= ANCHOR:
            raise ValueError(f"window must be over {ANCHOR} words")
        self.spark, self.window = spark, window
        self.bits = max(4, (text_bytes // BUCKET_BYTES).bit_length())
        self.map_bits = min(MOST_ANCHOR_BITS, max(20, self.bits + 3, text_bytes.bit_length() - 3))
        self.anchor_runs: list[DataFrame] = []
        self.window_runs: list[DataFrame] = []
        self.seen: list[DataFrame] = []

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 per row of docs."""
        batch = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        if len(self.window_runs) > MAX_RUNS:
            old = [*self.anchor_runs, *self.window_runs]
            self.anchor_runs, self.window_runs = ([self._compact(runs, anchors)] for runs, anchors in ((self.anchor_runs, True), (self.window_runs, False)))
            discard(*old)
        met = self._merge(self._anchors(batch), self.anchor_runs, self._merge_anchors(), "anchor-run")
        fresh = self._windows(batch, self._bitmap(met, "keys"))
        if self.seen:
            fresh = fresh.unionByName(self._late_windows(met))
        merged = self._merge(fresh, self.window_runs, self._merge_windows(), "window-run")
        marked = materialize(self._marked(merged), "marked")
        result = materialize(self._kept(batch, marked), "substring-result")
        discard(marked)
        self.anchor_runs.append(met.where(F.col("kind") == RUN))
        self.window_runs.append(merged.where(F.col("kind") == RUN))
        self.seen.append(batch)
        return result

    def _merge(self, fresh: DataFrame | None, runs: list[DataFrame], merge, tag: str) -> DataFrame:
        """Rows of each bucket, of the batch and of the runs, through merge in one task."""
        rows = fresh
        for run in runs:
            rows = run if rows is None else rows.unionByName(run)
        placed = rows.repartition(1 << self.bits, "bucket").sortWithinPartitions("bucket")
        return materialize(map_batches(placed, merge, _BLOCKS), tag)

    def _anchors(self, batch: DataFrame) -> DataFrame:
        window, bits = self.window, self.bits

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for part in text_slices(batches):
                words = textvec.find_words(part.column("text"), textvec.NOT_SPACE)
                at, anchor, _ = window_anchors(words, window)
                new = np.ones(len(at), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(at) != 1)
                docs = _doc_of(words, at[new], part.column("doc_id").to_numpy(zero_copy_only=False))
                yield anchor[new], docs, docs

        return map_batches(batch.where("doc_id is not null"), lambda batches: _spread(anchors(batches), bits, unite_anchors), _BLOCKS)

    def _merge_anchors(self):
        """The batch's run; bitmaps of its anchors that two documents have by now (keys) and of those that one earlier
        document had alone (checks); those documents."""
        bits, map_bits = self.bits, self.map_bits

        def bitmap(keys: np.ndarray, bucket: int) -> np.ndarray:
            own = np.zeros(1 << (map_bits - bits), bool)
            own[_top(keys, map_bits) - (bucket << (map_bits - bits))] = True
            return np.packbits(own, bitorder="little")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _buckets(batches):
                keys, last, first = unite_anchors(*_arrays(rows.get(FRESH, []), (np.uint64, np.int64, np.int64)))
                if not len(keys):
                    continue
                several = first != last
                old, old_several, old_first = _arrays(rows.get(RUN, []), (np.uint64, np.uint8, np.int64))
                there = np.isin(old, keys)
                old, old_several, old_first = old[there], old_several[there].astype(np.int64), old_first[there]
                order = np.argsort(old, kind="stable")
                old, old_several, old_first = old[order], old_several[order], old_first[order]
                at = _starts(old)
                alone = (np.diff([*at, len(old)]) == 1) & (old_several[at] == 0)
                met = np.union1d(keys[several], old[at])
                out = [_row(bucket, RUN, keys, several.astype(np.uint8), first), _row(bucket, MAP, bitmap(met, bucket), bitmap(old[at][alone], bucket))]
                if alone.any():
                    out.append(_row(bucket, OWNER, np.zeros(0, np.uint64), docs=np.unique(old_first[at][alone])))
                yield _batch(out)

        return merge

    def _bitmap(self, met: DataFrame, column: str) -> np.ndarray:
        """The buckets' parts put together."""
        size = 1 << (self.map_bits - self.bits - 3)
        out = np.zeros(size << self.bits, np.uint8)
        for r in met.where(F.col("kind") == MAP).select("bucket", column).toLocalIterator():
            out[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(bytes(r[column]), np.uint8)
        return out

    def _windows(self, batch: DataFrame, anchors: np.ndarray, owners: np.ndarray | None = None) -> DataFrame:
        """Windows whose anchor is in the bitmap, each once a document."""
        window, bits, map_bits = self.window, self.bits, self.map_bits
        context = self.spark.sparkContext
        anchors_in, docs_in = context.broadcast(anchors), None if owners is None else context.broadcast(owners)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for part in text_slices(batches):
                if docs_in is not None:
                    part = part.filter(pa.array(in_filter(docs_in.value, part.column("position").to_numpy())))
                words = textvec.find_words(part.column("text"), textvec.NOT_SPACE)
                at, anchor, h = window_anchors(words, window)
                at = at[in_filter(anchors_in.value, _top(anchor, map_bits))]
                w1, w2 = (x[at] for x in window_keys(words, h, window))
                yield w1, w2, _doc_of(words, at, part.column("doc_id").to_numpy(zero_copy_only=False))

        source = batch.where("doc_id is not null")
        if docs_in is not None:
            source = source.withColumn("position", filter_position(F.col("doc_id"), DOC_BITS))
        return map_batches(source, lambda batches: _spread(windows(batches), bits, unite_windows), _BLOCKS)

    def _late_windows(self, met: DataFrame) -> DataFrame:
        """Windows of earlier documents whose anchors were theirs alone until now."""

        def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for docs in part.column("docs").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64))], names=["doc_id"])

        late = map_batches(met.where(F.col("kind") == OWNER).select("docs"), owners, "doc_id long")
        docs_in, anchors, out = id_filter(late, "doc_id", DOC_BITS), self._bitmap(met, "checks"), None
        for docs in self.seen:
            part = self._windows(docs, anchors, docs_in)
            out = part if out is None else out.unionByName(part)
        return out

    def _merge_windows(self):
        """The batch's run; for each part of the batch's documents the windows that a smaller id has, too."""
        earlier, bits = len(self.seen), self.bits

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _buckets(batches):
                keys, checks, docs = unite_windows(*_arrays(rows.get(FRESH, [])))
                if not len(keys):
                    continue
                at = _starts(keys, checks)
                first = docs[at].copy()
                if earlier:
                    old_keys, old_checks, old_first = _arrays(rows.get(RUN, []))
                    for found, doc in _meet(keys[at], checks[at], old_keys, old_checks, old_first):
                        first[found] = np.minimum(first[found], doc)
                group = np.repeat(np.arange(len(at)), np.diff([*at, len(keys)]))
                gone = docs > first[group]
                marked, owner = mark_of(keys[gone], checks[gone]), docs[gone]
                part = _top(textvec.mix(owner.astype(np.uint64)), bits)
                order = np.lexsort((owner, part))
                marked, owner, part = marked[order], owner[order], part[order]
                out = [_row(bucket, MARK, marked[a:b], docs=owner[a:b], part=int(part[a])) for a, b in _spans(_starts(part), len(part))]
                yield _batch([_row(bucket, RUN, keys[at], checks[at], first), *out])

        return merge

    def _marked(self, merged: DataFrame) -> DataFrame:
        """doc_id, marked: the marked windows of each document that has any. The blocks of a part of the documents, one
        from each bucket, meet in one task; there are at most as many blocks as marks."""

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = (pa.RecordBatch.from_arrays([b.column(c) for c in ("part", "kind", "keys", "checks", "docs")], names=["bucket", "kind", "keys", "checks", "docs"]) for b in batches)
            for _, rows in _buckets(parts):
                keys, docs = (np.concatenate([np.frombuffer(r[i], kind) for r in rows[MARK]]) for i, kind in ((0, np.uint64), (2, np.int64)))
                order = np.argsort(docs, kind="stable")
                keys, docs = keys[order], docs[order]
                at = _starts(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array([keys[a:b].tobytes() for a, b in _spans(at, len(docs))], pa.binary())], names=["doc_id", "marked"])

        blocks = merged.where(F.col("kind") == MARK).repartition(1 << self.bits, "part").sortWithinPartitions("part")
        return map_batches(blocks, gather, _MARKED)

    def _kept(self, batch: DataFrame, marked: DataFrame) -> DataFrame:
        window, scanned, result = self.window, arrow_schema(_SCANNED), arrow_schema(_RESULT)
        docs_in = self.spark.sparkContext.broadcast(id_filter(marked, "doc_id", DOC_BITS))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Results of documents that have no mark; the others' text goes on."""
            for part in text_slices(batches):
                words = textvec.find_words(part.column("text"), textvec.NOT_SPACE)
                go_on = in_filter(docs_in.value, part.column("position").to_numpy())
                sha = [None if go_on[i] else hashlib.sha256(textvec.joined_words(words, i)).hexdigest() for i in range(part.num_rows)]
                texts = part.column("text").take(pa.array(np.arange(part.num_rows), mask=~go_on))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts()), pa.array(np.zeros(part.num_rows, np.int64)), pa.array(sha, pa.string()), texts], schema=scanned)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                words = textvec.find_words(part.column("text"), textvec.NOT_SPACE)
                h = mark_of(*window_keys(words, words.hashes(), window))
                removed, shas = [], []
                for i, (sha, marks) in enumerate(zip(part.column("kept_sha256").to_pylist(), part.column("marked").to_pylist(), strict=True)):
                    gone = np.zeros(int(words.first[i + 1] - words.first[i]), bool)
                    if sha is None:
                        if marks and len(gone) >= window:
                            own = h[words.first[i] : words.first[i + 1] - window + 1]
                            starts = np.flatnonzero(np.isin(own, np.frombuffer(marks, np.uint64)))
                            gone = textvec.covered(len(gone), starts, window)
                        sha = hashlib.sha256(textvec.joined_words(words, i, ~gone)).hexdigest()
                    removed.append(int(gone.sum()))
                    shas.append(sha)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], schema=result)

        rows = map_batches(batch.withColumn("position", F.coalesce(filter_position(F.col("doc_id"), DOC_BITS), F.lit(0))), scan, _SCANNED)
        return map_batches(rows.join(marked, "doc_id", "left"), finish, _RESULT)

    def _compact(self, runs: list[DataFrame], anchors: bool) -> DataFrame:
        """The runs of one kind as one."""

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _buckets(batches):
                keys, checks, first = _arrays(rows[RUN], (np.uint64, np.uint8 if anchors else np.uint64, np.int64))
                order = np.lexsort((first, keys)) if anchors else np.lexsort((first, checks, keys))
                keys, checks, first = keys[order], checks[order], first[order]
                at = _starts(keys) if anchors else _starts(keys, checks)
                several = np.maximum(np.maximum.reduceat(checks, at), (np.diff([*at, len(keys)]) > 1).astype(np.uint8)) if anchors else checks[at]
                yield _batch([_row(bucket, RUN, keys[at], several, first[at])])

        return self._merge(None, runs, merge, "compacted")


def _meet(keys: np.ndarray, checks: np.ndarray, old_keys: np.ndarray, old_checks: np.ndarray, old_first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index in the sorted, distinct batch, first document) of the runs' windows that the batch has, verified by the
    second hash. No index comes twice in one of the parts."""
    order = np.lexsort((old_first, old_checks, old_keys))
    old_keys, old_checks, old_first = old_keys[order], old_checks[order], old_first[order]
    least = _starts(old_keys, old_checks)
    old_keys, old_checks, old_first = old_keys[least], old_checks[least], old_first[least]
    at, left = np.searchsorted(keys, old_keys), np.arange(len(old_keys))
    while len(left):
        left = left[at[left] < len(keys)]
        left = left[keys[at[left]] == old_keys[left]]
        same = checks[at[left]] == old_checks[left]
        yield at[left[same]], old_first[left[same]]
        left = left[~same]  # the batch may have another window with this key
        at[left] += 1


def remove_repeats(docs: DataFrame, window: int = 13, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All of docs through a new index, in batches of ascending ids: doc_id, n_words, n_removed, kept_sha256."""
    key = F.col(id_col).cast("long")
    share = [i / batches for i in range(1, batches)] or [0.5]
    sizes = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)), F.percentile_approx(key, share, 1000)).first()
    cuts = sorted(set(sizes[1] or [])) if batches > 1 else []
    index, out = SubstringIndex(docs.sparkSession, window, sizes[0]), None
    for i, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        inside = F.lit(True) if hi is None else key <= hi
        inside = inside if lo is None else inside & (key > lo)
        if i == 0:
            inside = inside | key.isNull()
        part = index.add(docs.where(inside), id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out
