"""Best-fit packing of tokenised documents into fixed-length sequences, in bulk-synchronous rounds.

Tokens become pieces of at most `capacity`; only longer documents are cut. Pieces of one length are alike, and so are
gaps of one room, so a round works on stored tables of lengths with their numbers of pieces (at most `capacity` rows) and
of ranges of sequences with the same room. A round sorts lengths and rooms together. Lengths that follow each other and
the gaps up to the next length make a run: those gaps are the successors of all of its lengths. Inside a run all lengths
sweep to their gaps at once, each run in a task; where more pieces want a gap than it has slots for, rank decides: the longest piece first,
the tightest gap first. A length fills the gaps that it got, the gaps shrink, those not used go back, and the next round
begins, until no piece is left. Pieces that no gap can hold get new sequences, as few as could hold them.

Every piece then finds its own place by its length and rank in a distributed join. Ranks come from prefix sums over
salted counts, so a length that a third of the pieces share is spread over as many tasks as a shuffle has partitions.

Rounds grow with the number of different lengths in a sequence (some tens), not with the input. Words are known by 64-bit
hashes: of the at most CACHE_WORDS words that a worker remembers, two share one with a chance of 1 in ten million.

Defined cases: null or empty text is one piece, the end token; repeated rows are packed each; a null id is packed
like any other; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, map_batches, materialize, salts, ship_package, text_slices

#: Distinct words whose tokens a Python worker remembers; then it starts anew.
CACHE_WORDS = 1_500_000
#: New words that the tokenizer gets at once.
JOINED = 10_000
#: Percent of a gap that one round deals out in slots as wide as its run's longest length, one slot at least.
SLOT_SHARE = 100
#: Rows of the plan, 48 bytes each, that are broadcast; a larger plan is shuffled.
MOST_BROADCAST = 500_000

#: A length (kind 0: length, pieces, first rank), a range of gaps (1: first sequence, number, room), or a move (2: length,
#: first rank, pieces, first sequence, pieces in each, offset).
_STATE = "kind int, a long, b long, c long, d long, e long, f long"
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: ASCII letters; and the marks that end a run of letters for the tokenizer. The apostrophe begins a suffix like 's,
#: and <, | and > belong to the names of special tokens, so words aren't cut there.
_LETTER, _MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"))


def token_words(texts: pa.Array) -> textvec.Words:
    """Words between ASCII white space, cut once more where a letter meets a mark."""
    words = textvec.find_words(texts, textvec.NOT_SPACE)
    data = words.data[:-8]
    if not len(words):
        return words
    # Two-byte letters: 0xC3 and a byte that isn't that of the signs for times and divided by.
    two = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    begins, ends = _LETTER[data], _LETTER[data]
    begins[:-1] |= two
    ends[1:] |= two
    mark = _MARK[data]
    cuts = np.flatnonzero((ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:])) + 1
    inside = np.searchsorted(words.starts, cuts, "right") - 1
    cuts = cuts[(inside >= 0) & (cuts < words.ends[inside]) & (cuts > words.starts[inside])]
    starts = np.sort(np.concatenate([words.starts, cuts]))
    first = np.searchsorted(starts, np.append(words.starts, len(words.data)))[words.first]
    return textvec.Words(words.data, starts, np.sort(np.concatenate([words.ends, cuts])), first)


class WordTokens:
    """Token ids of words that this kind of tokenizer treats apart; remembers them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        parts = [self.tokenizer.encode(" ".join(words[i : i + JOINED]), add_special_tokens=False) for i in range(0, len(words), JOINED)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in parts])
        # A token belongs to the word that its first character lies in.
        ends = np.cumsum([len(w) + 1 for w in words])
        base = [0, *ends[JOINED - 1 :: JOINED].tolist()]
        first = np.concatenate([np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)) + b for e, b in zip(parts, base, strict=False)])
        size = np.bincount(np.searchsorted(ends, first, "right"), minlength=len(words))
        at = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, flat])
        where = np.searchsorted(self.keys, keys)
        self.at, self.size = np.insert(self.at, where, at.astype(np.int32)), np.insert(self.size, where, size.astype(np.int32))
        self.keys = np.insert(self.keys, where, keys)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, offset of each text and the total)."""
        words = token_words(texts)
        keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, keys)
        fresh = np.ones(len(keys), bool)
        inside = known < len(self.keys)
        fresh[inside] = self.keys[known[inside]] != keys[inside]
        if fresh.any():
            if len(self.keys) > CACHE_WORDS:
                self.clear()
                fresh[:] = True
            self.learn(keys[fresh], [words.text(i).decode() for i in first[fresh]])
            known = np.searchsorted(self.keys, keys)
        at, size = self.at[known][back], self.size[known][back]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[words.first]


_TOKENIZERS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokens(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each document."""
    ddl = _PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        for batch in text_slices(batches):
            ids, off = words.encode(batch.column("text"))
            lengths = np.diff(off) + 1
            pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(lengths[doc] - start, capacity)
            own = []
            for d in range(len(lengths)):
                full = np.append(ids[off[d] : off[d + 1]], np.uint32(end_id)).astype("<u4")
                own += [full[a : a + capacity] for a in range(0, len(full), capacity)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in own], schema.field("ids").type))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, run, ddl)


def matched_run(lengths: np.ndarray, gaps: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Rows of the state after one round of a run. lengths: (length, pieces, first rank); gaps: (first sequence,
    number, room); each gap holds each length.

    The longest pieces rank first and meet the tightest gaps. A gap goes to the length that its first slot falls on; a
    length fills the gaps it got, the tightest first.
    """
    lengths, gaps = lengths[np.argsort(-lengths[:, 0])], gaps[np.lexsort((gaps[:, 0], gaps[:, 2]))]
    slots = np.maximum(1, gaps[:, 2] // lengths[0, 0] * SLOT_SHARE // 100)
    ends, at = np.cumsum(gaps[:, 1] * slots), 0
    rank, out = 0, []
    cursor = 0  # sequences of the gap range `at` that are dealt
    for length, n, lo in lengths.tolist():
        left, rank = n, rank + n
        while at < len(gaps):
            first, m, room = gaps[at].tolist()
            # Gaps of this range whose first slot ranks before the end of this length's pieces.
            high = min(m, int(-(-(rank - (ends[at] - m * slots[at])) // slots[at])))
            each = room // length
            used = min(high - cursor, -(-left // each)) if high > cursor else 0
            if used:
                placed = min(left, used * each)
                full, rest = divmod(placed, each)
                out.append((2, length, lo + n - left, placed, first + cursor, each, capacity - room))
                out.append((1, first + cursor, full, room - each * length, None, None, None))
                out.append((1, first + cursor + full, used - full, room - rest * length, None, None, None))
                left -= placed
            if high > cursor:
                out.append((1, first + cursor + used, high - cursor - used, room, None, None, None))
                cursor = high
            if cursor < m:
                break  # the next slot ranks after this length's pieces
            at, cursor = at + 1, 0
        out.append((0, length, left, lo + n - left, None, None, None))
    if at < len(gaps):
        out.append((1, int(gaps[at, 0]) + cursor, int(gaps[at, 1]) - cursor, int(gaps[at, 2]), None, None, None))
        out += [(1, first, m, room, None, None, None) for first, m, room in gaps[at + 1 :].tolist()]
    return [r for r in out if r[0] == 2 or r[2] > 0 and (r[0] == 0 or r[3] > 0)]


def _round(state: DataFrame, capacity: int) -> DataFrame:
    """The state after a round: what is left, and the round's moves."""
    schema = arrow_schema(_STATE)
    size = F.when(F.col("kind") == 0, F.col("a")).otherwise(F.col("c"))
    order = Window.orderBy(size, "kind", "a")  # lengths and ranges of gaps; a length comes before the gap of its size
    opens = (F.col("kind") == 0) & (F.coalesce(F.lag("kind").over(order), F.lit(1)) == 1)
    # A run: lengths without a gap between them, and the gaps up to the next length. Gaps before any length are full.
    runs = state.withColumn("opens", opens.cast("long")).withColumn("run", F.sum("opens").over(order)).where("run > 0")

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        rows = np.stack([table[c].to_numpy() for c in "abc"], 1)
        if kind.all() or not kind.any():
            return table.select(schema.names).cast(schema)
        found = matched_run(rows[kind == 0], rows[kind == 1], capacity)
        return pa.table([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    ship_package(state.sparkSession)
    return runs.select("run", *schema.names).groupBy("run").applyInArrow(run, _STATE)


def best_fit_rounds(counts: DataFrame, capacity: int) -> DataFrame | None:
    """The plan: length, lo, n, first_seq, each, offset0 for n pieces of a length from rank lo on; None without pieces.

    counts: length, n. The table of lengths and of ranges of alike gaps is written after each round with the round's
    moves; the driver sees the number of lengths left and what no gap can hold, for which it opens the fewest sequences
    that could.
    """
    spark, opened, plan = counts.sparkSession, 0, None
    none = [F.lit(None).cast("long").alias(c) for c in "def"]
    state, row = _stored(counts.select(F.lit(0).alias("kind"), F.col("length").cast("long").alias("a"), F.col("n").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), *none), capacity)
    while row["left"]:
        now = state.where("kind < 2")
        if fresh := max(row["alone"], -(-row["tokens"] // capacity)):
            now = now.unionByName(spark.range(1).select(F.lit(1).alias("kind"), F.lit(opened).cast("long").alias("a"), F.lit(fresh).cast("long").alias("b"), F.lit(capacity).cast("long").alias("c"), *none))
            opened += fresh
        state, row = _stored(_round(now, capacity), capacity)
        moves = state.where("kind = 2").select(F.col("a").alias("length"), F.col("b").alias("lo"), F.col("c").alias("n"), F.col("d").alias("first_seq"), F.col("e").alias("each"), F.col("f").alias("offset0"))
        plan = moves if plan is None else plan.unionByName(moves)
    return plan


def _stored(state: DataFrame, capacity: int) -> tuple[DataFrame, dict[str, int]]:
    """The state as a written table; lengths left, tokens of pieces longer than any room, and how many of those need
    sequences of their own."""
    seen = Observation()
    stuck = F.when((F.col("kind") == 0) & (F.col("a") > F.col("widest")), F.col("b"))
    widest = F.coalesce(F.max(F.when(F.col("kind") == 1, F.col("c"))).over(Window.partitionBy()), F.lit(0))
    counts = (F.count_if(F.col("kind") == 0).alias("left"), F.coalesce(F.sum(stuck * F.col("a")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("a") > capacity // 2, stuck)), F.lit(0)).alias("alone"))
    return materialize(state.withColumn("widest", widest).observe(seen, *counts).drop("widest"), "packing-state"), seen.get


def best_fit_pack(pieces: DataFrame, capacity: int, keep: tuple[str, ...] = ("doc_id", "piece", "start", "length", "ids_crc32")) -> DataFrame:
    """Adds sequence_id and offset to pieces, which need a column length from 1 to capacity."""
    parts = salts(pieces.sparkSession)
    rows = materialize(pieces.select(*keep).withColumn("row_key", F.monotonically_increasing_id()), "pieces").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(parts)))
    salted = materialize(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "piece-counts")  # at most capacity * parts rows
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = best_fit_rounds(salted.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    if plan is None:
        return rows.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    plan = materialize(plan, "packing-plan")
    plan = F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan
    inside = Window.partitionBy("length", "salt").orderBy("row_key")
    ranked = rows.withColumn("in_salt", F.row_number().over(inside) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("in_salt"))
    at = F.col("rank") - F.col("lo")
    return ranked.join(plan, (ranked["length"] == plan["length"]) & (at >= 0) & (at < F.col("n"))).select(
        *(ranked[c] for c in keep),
        (F.col("first_seq") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + at % F.col("each") * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    return best_fit_pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids: the token ids of every sequence, whose size capacity bounds."""
    keep = ("doc_id", "piece", "start", "length", "ids")
    packed = best_fit_pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=True), capacity, keep)
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
