"""Ranked lexical search over inverted treaps.

The index has one row for each segment, a run of documents with about SEGMENT_BYTES of text. In it every term has a
posting list in document order, and over the list a treap: a binary search tree by document and a heap by impact, the
part of a score that the posting gives before it is weighed by its term. A node so holds the greatest impact of its
subtree. All treaps of a segment are built at once, from each posting's nearest greater neighbours.

A search goes down the treaps of a query's terms together. A state is a range of documents and, for each term, the
treap's node for that range; the sum of the nodes' weighed impacts bounds every score in the range. A range whose bound
is below the query's k-th best score so far is pruned with all its subtrees. Else the document of the greatest node is
scored, by a descent in each treap, and the range falls into two; a range of at most LEAF documents is scored whole.
Ranges of high bound go first. A task keeps each query's best k over all its segments, so later ones prune more; what
leaves a task is at most k rows a query, united in two steps.

Queries come in blocks of about BLOCK_TERMS terms, one at a time to all tasks; an item is never cut. The index does not
depend on the queries, only on the number of documents with terms and the number of all terms.

Terms go by 64-bit hashes: n different terms of the corpus and q of the queries are confused with a chance of n * q / 2**64.

Scores are integers, in 64 bits, `div` rounding down: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a
posting's impact 1000000000 tf div (1000 tf + 20 m), m = 50 + 50 n N div L; N: documents with a term, L: all their terms,
n: the document's terms.

Defined cases: null text has no terms; rows that share an id are documents of their own, ties go by ascending id and
a null id comes last; benchmark rows that share an item_id are queries of their own; an item without terms, or whose
terms no document has, gives no rows; an empty table gives none. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, map_batches, materialize, string_lengths, text_slices
from lodestone.llm.textvec import ALNUM, find_words

SEGMENT_BYTES = 8 << 20
BLOCK_TERMS = 1 << 18
#: Ranges of so few documents are scored whole.
LEAF = 64
#: Pairs of a range and a term that one vectorised step works on.
CELLS = 1 << 16
#: Parts that the tasks' best rows of one query are first united in.
PARTS = 64

_INDEX = "n_docs int, ids binary, no_id binary, terms binary, starts binary, roots binary, docs binary, impacts binary, lefts binary, rights binary"
_FOUND = "item_key long, doc_id long, score long"


def segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together to about `limit` bytes of text, or one row."""
    held, size = [], 0
    for piece in text_slices(batches, "text", limit):
        more = int(string_lengths(piece.column("text")).sum())
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(piece)
        size += more
    if held:
        yield pa.concat_batches(held)


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts = find_words(batch.column("text"), ALNUM, lower=True).counts()
            yield pa.RecordBatch.from_pydict({"n": [int((counts > 0).sum())], "l": [int(counts.sum())]})

    row = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _nearest(impact: np.ndarray, lists: np.ndarray, step: int, ties: bool) -> np.ndarray:
    """For each posting the nearest one before (step -1) or behind it in its list that is greater, or as great where ties; else -1."""
    n = len(impact)
    near = np.arange(n) + step
    near[(near < 0) | (near >= n)] = -1
    near[lists[near] != lists] = -1
    live = np.flatnonzero(near >= 0)
    while len(live):
        there = impact[near[live]]
        live = live[(there < impact[live]) if ties else (there <= impact[live])]
        near[live] = near[near[live]]
        live = live[near[live] >= 0]
    return near


def build_treaps(impact: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left child, right child, root of each list); postings lie by list and document, of equal impacts the first is above."""
    n = len(impact)
    before, behind = _nearest(impact, lists, -1, True), _nearest(impact, lists, 1, False)
    # The parent is the lesser of the two greater neighbours; where both are equal, the one behind.
    low = impact.astype(np.int64)
    up_left = (before >= 0) & ((behind < 0) | (low[before] < low[behind]))
    up_right = (behind >= 0) & ~up_left
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    right[before[up_left]] = np.flatnonzero(up_left)
    left[behind[up_right]] = np.flatnonzero(up_right)
    return left, right, np.flatnonzero(~up_left & ~up_right).astype(np.int32)


def index_segment(ids: np.ndarray, no_id: np.ndarray, texts: pa.Array, n_docs: int, n_terms: int) -> dict[str, list]:
    """One row of the index; documents are put in order of their ids."""
    by_id = np.lexsort((ids, no_id))
    words = find_words(texts.take(pa.array(by_id)), ALNUM, lower=True)
    own, hashed, of = words.counts().astype(np.int64), words.hashes(), words.texts()
    order = np.argsort(hashed, kind="stable")  # documents ascend within a term
    hashed, of = hashed[order], of[order]
    edge = np.ones(len(hashed), bool)
    edge[1:] = (hashed[1:] != hashed[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(edge)
    tf = np.diff(np.append(first, len(hashed))).astype(np.int64)
    term, doc = hashed[first], of[first].astype(np.int32)
    weight = 50 + 50 * own * n_docs // max(n_terms, 1)
    impact = (1_000_000_000 * tf // (1000 * tf + 20 * weight[doc])).astype(np.int32)
    opens = np.ones(len(term), bool)
    opens[1:] = term[1:] != term[:-1]
    starts = np.flatnonzero(opens).astype(np.int32)
    left, right, roots = build_treaps(impact, np.cumsum(opens))
    arrays = {"ids": ids[by_id], "no_id": no_id[by_id], "terms": term[starts], "starts": np.append(starts, len(term)).astype(np.int32), "roots": roots, "docs": doc, "impacts": impact, "lefts": left, "rights": right}
    return {"n_docs": [len(ids)]} | {k: [v.tobytes()] for k, v in arrays.items()}


def build_index(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all documents.

    Its rows are large, so Parquet's writer is told to look at the size of what it holds after each row, not after 100, and
    to keep neither values for a dictionary nor, until its file ends, the least and greatest value of each row group: a
    task holds a few rows, however many it writes, and a reader one row group.
    """
    schema = arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, SEGMENT_BYTES):
            ids = batch.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_pydict(index_segment(values, no_id, batch.column("text"), n_docs, n_terms), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    writer = {"parquet.block.size": 2 * SEGMENT_BYTES, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}
    return materialize(map_batches(rows, run, _INDEX), "treaps", **writer)


@dataclass
class Queries:
    """Items by number: key, first (where its terms begin in terms and weights, and their number at the end)."""

    key: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Best:
    """The best k rows of each query so far; least: the score that another must reach."""

    k: int
    least: np.ndarray
    query: np.ndarray
    score: np.ndarray
    doc_id: np.ndarray
    no_id: np.ndarray

    @classmethod
    def none(cls, k: int, n: int) -> Best:
        return cls(k, np.ones(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def add(self, query: np.ndarray, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        new = score >= self.least[query]
        if not new.any():
            return
        own = {"query": query, "score": score, "doc_id": doc_id, "no_id": no_id}
        own = {c: np.concatenate([getattr(self, c), v[new]]) for c, v in own.items()}
        order = np.lexsort((own["doc_id"], own["no_id"], -own["score"], own["query"]))
        found = own["query"][order]
        rank = np.arange(len(found)) - np.searchsorted(found, found)
        order, rank = order[rank < self.k], rank[rank < self.k]
        for c, v in own.items():
            setattr(self, c, v[order])
        last = rank == self.k - 1
        self.least[self.query[last]] = self.score[last]


class Segment:
    """A row of the index; node -1 is no node and gives nothing."""

    def __init__(self, row: dict) -> None:
        of = lambda name, kind: np.frombuffer(row[name], kind)
        self.n = row["n_docs"]
        self.ids, self.no_id, self.terms, self.starts, self.roots = of("ids", np.int64), of("no_id", bool), of("terms", np.uint64), of("starts", np.int32), of("roots", np.int32)
        self.docs, self.impacts, self.lefts, self.rights = (np.append(of(c, np.int32), np.int32(x)) for c, x in (("docs", -1), ("impacts", 0), ("lefts", -1), ("rights", -1)))
        self.places = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * np.int64(self.n) + self.docs[:-1]

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """The posting list of each term, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For ranges (rows) and terms (columns): the greatest node at or below the given one with low <= document < high."""
        out, width = nodes.ravel().copy(), nodes.shape[1]
        live = np.flatnonzero(out >= 0)
        while len(live):
            at, of = out[live], live // width
            doc = self.docs[at]
            small, big = doc < low[of], doc >= high[of]
            astray = small | big
            live, at, small = live[astray], at[astray], small[astray]
            out[live] = np.where(small, self.rights[at], self.lefts[at])
            live = live[out[live] >= 0]
        return out.reshape(nodes.shape)

    def search(self, queries: Queries, best: Best) -> None:
        """Better best by this segment, queries of like length together."""
        lengths = np.diff(queries.first)
        order, at = np.argsort(lengths, kind="stable"), 0
        order = order[lengths[order] > 0]
        while at < len(order):
            # The longest in a group is at most twice as long as the shortest.
            to = max(at + 1, min(int(np.searchsorted(lengths[order], 2 * lengths[order[at]], "right")), at + max(1, CELLS // int(lengths[order[at]]))))
            self._search(queries, order[at:to], best)
            at = to

    def _search(self, queries: Queries, group: np.ndarray, best: Best) -> None:
        lengths = np.diff(queries.first)[group]
        width = int(lengths.max())
        cell = np.arange(width)
        real = cell < lengths[:, None]
        source = np.where(real, queries.first[group][:, None] + cell, 0)
        lists = np.where(real, self.lists(queries.terms[source]), -1)
        weights = np.where(lists >= 0, queries.weights[source], 0)
        nodes = np.where(lists >= 0, self.roots[lists] if len(self.roots) else -1, -1)
        query = np.flatnonzero(nodes.max(axis=1) >= 0)
        state = [query, np.zeros(len(query), np.int64), np.full(len(query), self.n, np.int64), nodes[query], (weights[query] * self.impacts[nodes[query]]).sum(axis=1)]
        step = max(16, CELLS // width)
        while True:
            alive = state[4] >= best.least[group[state[0]]]
            state = [x[alive] for x in state]
            if not len(state[0]):
                return
            # Of each query its ranges of highest bound first.
            order = np.lexsort((-state[4], state[0]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(state[0][order], state[0][order])
            chosen = np.argsort(rank, kind="stable")[:step]
            rest = np.ones(len(order), bool)
            rest[chosen] = False
            query, low, high, nodes, _ = (x[chosen] for x in state)
            whole = high - low <= LEAF
            self._score_ranges(query[whole], low[whole], high[whole], lists, weights, group, best)
            query, low, high, nodes = (x[~whole] for x in (query, low, high, nodes))
            more = []
            if len(query):
                weighed = weights[query] * self.impacts[nodes]
                doc = self.docs[nodes[np.arange(len(query)), weighed.argmax(axis=1)]].astype(np.int64)
                hit = self.within(nodes, doc, doc + 1)
                best.add(group[query], (weights[query] * self.impacts[hit]).sum(axis=1), self.ids[doc], self.no_id[doc])
                for a, b in ((low, doc), (doc + 1, high)):
                    below = self.within(nodes, a, b)
                    more.append([query, a, b, below, (weights[query] * self.impacts[below]).sum(axis=1)])
            state = [np.concatenate([x[rest], *(m[i] for m in more)]) for i, x in enumerate(state)]

    def _score_ranges(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, lists: np.ndarray, weights: np.ndarray, group: np.ndarray, best: Best) -> None:
        if not len(query):
            return
        of, cell = np.nonzero(lists[query] >= 0)
        base = lists[query[of], cell] * np.int64(self.n)
        begin, end = np.searchsorted(self.places, base + low[of]), np.searchsorted(self.places, base + high[of])
        count = end - begin
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - begin, count)
        of, cell = np.repeat(of, count), np.repeat(cell, count)
        scores = np.zeros((len(query), LEAF), np.int64)
        np.add.at(scores, (of, self.docs[post] - low[of]), weights[query[of], cell] * self.impacts[post])
        row, at = np.nonzero(scores >= best.least[group[query]][:, None])
        doc = low[row] + at
        best.add(group[query[row]], scores[row, at], self.ids[doc], self.no_id[doc])


def _query_terms(items: DataFrame) -> DataFrame:
    """item_key, term (the hash's bits as a long), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = find_words(batch.column("text"), ALNUM, lower=True)
            keys = batch.column("item_key").to_numpy(zero_copy_only=False)[words.texts()]
            yield pa.RecordBatch.from_pydict({"item_key": keys, "term": words.hashes().view(np.int64)})

    return map_batches(items, run, "item_key long, term long").distinct()


def _document_counts(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the (sorted) terms; terms that none holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own, sizes = np.frombuffer(row["terms"], np.uint64), np.diff(np.frombuffer(row["starts"], np.int32))
                _, mine, here = np.intersect1d(terms, own, assume_unique=True, return_indices=True)
                total[mine] += sizes[here]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int64), "df": total[at]})

    counts = map_batches(index.select("terms", "starts"), run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
    return {r["at"]: r["df"] for r in counts.collect()}  # at most the block's terms


def _block_queries(rows: pa.Table, index: DataFrame, n_docs: int) -> Queries:
    keys, terms = rows.column("item_key").to_numpy(), rows.column("term").to_numpy().view(np.uint64)
    known = np.unique(terms)
    counts = _document_counts(index, known)
    df = np.array([counts.get(i, 0) for i in range(len(known))], np.int64)
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    place = np.searchsorted(known, terms)
    useful = (df[place] > 0) & (weight[place] > 0)
    order = np.lexsort((terms[useful], keys[useful]))
    keys, terms, weights = keys[useful][order], terms[useful][order], weight[place][useful][order]
    own, first = np.unique(keys, return_index=True)
    return Queries(own, np.append(first, len(keys)), terms, weights)


def search_index(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """item_key, doc_id, score: of each task the best k of each query."""
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best.none(k, len(queries.key))
        for batch in batches:
            for i in range(batch.num_rows):
                Segment(batch.slice(i, 1).to_pylist()[0]).search(queries, best)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries.key[best.query], pa.int64()), pa.array(best.doc_id, pa.int64(), mask=best.no_id), pa.array(best.score, pa.int64())], schema=schema
        )

    return map_batches(index, run, _FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    n_docs, n_terms = corpus_size(docs, text_col)
    keyed = materialize(items.select(F.monotonically_increasing_id().alias("item_key"), F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")), "search-items")
    terms = materialize(_query_terms(keyed.select("item_key", "text")), "search-terms")
    blocks = -(-terms.count() // BLOCK_TERMS) if n_docs else 0
    found = spark.createDataFrame([], _FOUND)
    if blocks:
        index = build_index(docs, n_docs, n_terms, id_col, text_col)
        block = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
        blocked = terms if blocks == 1 else materialize(terms.withColumn("block", block).repartitionByRange(blocks, "block").sortWithinPartitions("block"), "search-blocks")
        for b in range(blocks):
            rows = (blocked if blocks == 1 else blocked.where(F.col("block") == b)).select("item_key", "term").toArrow()
            queries = _block_queries(rows, index, n_docs)
            if len(queries.key):
                part = F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(PARTS))
                tops = search_index(index, queries, k).withColumn("part", part)
                found = found.unionByName(materialize(_best_rows(tops, ["item_key", "part"], k), "search-found").select("item_key", "doc_id", "score"))
    return _best_rows(found, ["item_key"], k).join(keyed.select("item_key", "item_id"), "item_key").select("item_id", "rank", "doc_id", "score")


def _best_rows(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
