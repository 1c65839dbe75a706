"""Near-duplicate components by b-bit MinHash.

A document's set is its distinct word shingles, as 64-bit hashes. Documents with the same set form one class at once.
Of each class, 128 minima make 32 band keys of 4 minima each: sets as alike as 0.8 share no band once in 20 million
times. Of each minimum 4 low bits are kept and packed into eight words; the number of equal nibbles, corrected for
chance collisions, estimates the similarity of two members of a bucket, and members five and a half standard errors
below the wanted similarity go no further. The others' full sets decide.

Buckets aren't expanded into pairs. Each (in blocks of BLOCK members, with the bucket's first member in every block)
gives a spanning forest of greatest estimates, so a group of m near copies costs m - 1 candidate pairs. The candidate
pairs' components are clusters: any two members of one block that the estimate allows are in one. In a bucket of more
blocks, members of different clusters are then compared block against block, and clusters that the estimate allows to
link are joined; a group of near copies is one cluster by then and costs nothing. Within a cluster
(block against block of at most BLOCK_SHINGLES hashes, if it is larger) one pass counts the shingles that a member
shares with all others at once, full sets against full sets, and merges what links; only links that merge leave the
task, and members that have merged with all they could link with are skipped.

A link is lost only by chance: where its two sets share no band (once in 20 million), or where the estimate errs by
over five and a half standard errors (once in ten million). No size of a bucket or of a cluster drops one.

Defined cases: texts without words (null, too) have an empty set and link with nothing; fewer words than a shingle
make one shingle of all of them; repeated rows are linked and each gets its row; a row with null id links with
nothing and is kept; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, filter_position, id_filter, in_filter, map_batches, materialize, text_slices, with_row_key
from lodestone.llm.components import connected_components

BANDS, BAND_ROWS, BITS = 32, 4, 4
HASHES = BANDS * BAND_ROWS
#: Members of a bucket that are compared in one step.
BLOCK = 2048
#: Shingle hashes of a cluster that one task holds of either side: 8 bytes each.
BLOCK_SHINGLES = 1 << 21
#: Bits (as a power of 2) of the bitmap that spares documents without a candidate.
DOC_BITS = 22

_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary"
_PAIRS = "a long, b long"
_SETS = "node long, shingles binary"

_FACTORS = np.random.default_rng(20240229).integers(1 << 20, 1 << 32, HASHES, np.uint64).astype(np.uint32) | np.uint32(1)
_NIBBLES = np.uint64(0x1111111111111111)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text."""
    words = textvec.find_words(texts, textvec.NOT_SPACE, lower=True)
    h = words.hashes()
    grams = textvec.window_hashes(h, k)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield textvec.window_hashes(h[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of the set under HASHES permutations of 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (_FACTORS[:, None] * x[None, i : i + 1024]).min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """Key of each band, for rows of minima."""
    rows = least.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND_ROWS):
        key = textvec.mix(key ^ rows[:, :, j] * np.uint64(0xD6E8FEB86659FD93))
    return key


def pack(least: np.ndarray) -> np.ndarray:
    """The BITS low bits of each minimum, as 64-bit words; they are taken above the bit that odd factors keep."""
    low = (least >> np.uint32(2) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)


def matches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of equal nibbles of packed signatures, by counting bits."""
    x = one ^ many
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return HASHES - np.bitwise_count(x & _NIBBLES).sum(-1, dtype=np.int64)


def similarity(equal: np.ndarray | int) -> np.ndarray | float:
    """Collision-corrected estimate of the Jaccard similarity."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def least_matches(threshold: float) -> int:
    """Equal nibbles that sets of this similarity have but once in some ten million times."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return max(0, math.floor(HASHES * p - 5.5 * math.sqrt(HASHES * p * (1 - p))))


def _sign(k: int):
    schema = arrow_schema(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, ids, least = [], [], []
            for own in shingle_sets(batch.column("text"), k):
                sizes.append(len(own))
                ids.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64))
                least.append(minima(own))
            least, ids = np.stack(least), np.stack(ids)
            keys = pa.array(band_keys(least).view(np.int64).ravel())
            offsets = pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32))
            packed = pack(least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.ListArray.from_arrays(offsets, keys, type=schema.field("bands").type), pa.array([p.tobytes() for p in packed], pa.binary())],
                schema=schema,
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of groups and the end): whole groups of rows sorted by bucket and part, many at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        starts = _group_starts(rest)
        if len(starts) > 1:
            yield rest.slice(0, int(starts[-1])), starts
            rest = rest.slice(int(starts[-1]))
    if rest is not None:
        yield rest, np.append(_group_starts(rest), rest.num_rows)


def _group_starts(rows: pa.Table) -> np.ndarray:
    keys = np.stack([rows[c].to_numpy() for c in ("bucket", "part")], 1)
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1])


def _signatures(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)


def spanning_forest(nodes: np.ndarray, signatures: np.ndarray, cut: int) -> Iterator[tuple[int, int]]:
    """Edges of greatest estimate that connect what the cut lets be connected."""
    left = np.arange(1, len(nodes))
    best, parent = matches(signatures[0], signatures[left]), np.zeros(len(left), np.int64)
    while len(left):
        i = int(best.argmax())
        new = left[i]
        if best[i] >= cut:
            yield nodes[parent[i]], nodes[new]
        left, best, parent = (np.delete(x, i) for x in (left, best, parent))
        equal = matches(signatures[new], signatures[left])
        closer = equal > best
        best[closer], parent[closer] = equal[closer], new


def _forests(cut: int):
    schema = arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            nodes, signatures, sizes = rows["node"].to_numpy(), _signatures(rows), np.diff(starts)
            two = starts[:-1][sizes == 2]
            two = two[matches(signatures[two], signatures[two + 1]) >= cut]
            pairs = [np.stack([nodes[two], nodes[two + 1]], 1)]
            for a, n in zip(starts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found = list(spanning_forest(nodes[a : a + n], signatures[a : a + n], cut))
                pairs.append(np.array(found, np.int64).reshape(-1, 2))
            yield _pair_batch(np.concatenate(pairs), schema)

    return run


def crossing_pairs(nodes: np.ndarray, sides: np.ndarray, clusters: np.ndarray, signatures: np.ndarray, cut: int) -> Iterator[tuple[int, int]]:
    """Pairs of side 0 with side 2 that the cut lets be connected and that merge clusters."""
    _, label = np.unique(clusters, return_inverse=True)
    right = np.flatnonzero(sides == 2)
    for i in np.flatnonzero(sides == 0).tolist():
        others = right[label[right] != label[i]]
        for j in others[matches(signatures[i], signatures[others]) >= cut].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield nodes[i], nodes[j]


def _crossings(cut: int):
    schema = arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            nodes, sides, clusters, signatures = rows["node"].to_numpy(), rows["side"].to_numpy(), rows["cluster"].to_numpy(), _signatures(rows)
            found = [p for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for p in crossing_pairs(nodes[a:b], sides[a:b], clusters[a:b], signatures[a:b], cut)]
            yield _pair_batch(np.array(found, np.int64).reshape(-1, 2), schema)

    return run


def merging_links(nodes: np.ndarray, sides: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], cut: int, links: Callable) -> Iterator[tuple[int, int]]:
    """Links of full sets that merge members: side 0 against 2, or all of side 1. links: of arrays shared, united."""
    sizes = np.array([len(x) for x in sets])
    off = np.cumsum(sizes) - sizes
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, marks = np.arange(len(nodes)), np.zeros(int(ids.max()) + 1, bool)
    for i in np.flatnonzero(sides < 2).tolist():
        others = np.flatnonzero((label != label[i]) & (sides > 0) & (nodes != nodes[i]))
        if not len(others):
            continue
        others = others[links(np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i]))]
        others = others[matches(signatures[i], signatures[others]) >= cut]
        if not len(others):
            continue
        marks[ids[off[i] : off[i] + sizes[i]]] = True
        if len(others) * 4 > len(nodes):
            shared = np.add.reduceat(marks[ids].astype(np.int64), off)[others]
        else:
            shared = np.array([int(marks[ids[off[j] : off[j] + sizes[j]]].sum()) for j in others.tolist()])
        marks[ids[off[i] : off[i] + sizes[i]]] = False
        for j in others[links(shared, sizes[i] + sizes[others] - shared)].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield nodes[i], nodes[j]


def _links(cut: int, links: Callable):
    schema = arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _groups(batches):
            nodes, sides, signatures = rows["node"].to_numpy(), rows["side"].to_numpy(), _signatures(rows)
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            found = [p for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for p in merging_links(nodes[a:b], sides[a:b], signatures[a:b], sets[a:b], cut, links)]
            yield _pair_batch(np.array(found, np.int64).reshape(-1, 2), schema)

    return run


def _pair_batch(pairs: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)


def cluster_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, shingles of the documents that are in nodes."""
    schema = arrow_schema(_SETS)
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(nodes, "node", DOC_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            batch = batch.filter(pa.array(in_filter(wanted.value, batch.column("position").to_numpy())))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k)], pa.binary())], schema=schema)

    source = docs.where("doc_id is not null").withColumn("position", filter_position(F.col("doc_id"), DOC_BITS))
    return map_batches(source, sets, _SETS)


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row; a link is 100 * shared >= percent * united shingles."""
    if not 50 <= percent <= 100:
        raise ValueError("bands are laid out for 50 to 100 percent; below 80 the chance of missing a link grows")
    cut = least_matches(percent / 100)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(map_batches(source, _sign(shingle), _SIGNED), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"))
    rows = materialize(signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id")).alias("node")), "classes")

    members = linkable.join(classes, ["s1", "s2"]).where("doc_id = node")
    banded = members.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    buckets = materialize(banded.join(shared, "bucket"), "buckets")
    signature = members.select("node", "signature")

    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    # The first member of a large bucket goes into every block, so that blocks get connected.
    own = F.when((F.col("node") == F.col("first")) & (parts > 1), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(block))
    spread = buckets.select("bucket", "node", F.explode(own).alias("part")).join(signature, "node")
    pairs = map_batches(_grouped(spread.select("bucket", "part", "node", "signature")), _forests(cut), _PAIRS)
    clusters = materialize(connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), "clusters")
    large = buckets.where(F.col("n") > BLOCK)
    if not large.isEmpty():
        # What blocks of one bucket may link with each other goes on from the clusters that they have so far.
        known = large.join(clusters, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("cluster"))
        mixed = known.groupBy("bucket").agg(F.min("cluster").alias("_a"), F.max("cluster").alias("_b")).where("_a < _b").select("bucket")
        across = F.filter(_block_pairs(block, parts), lambda o: o["side"] != 1)
        opposed = known.join(mixed, "bucket").select("bucket", "node", "cluster", F.explode(across).alias("o")).select("bucket", "node", "cluster", "o.part", "o.side")
        crossing = map_batches(_grouped(opposed.join(signature, "node").select("bucket", "part", "node", "side", "cluster", "signature")), _crossings(cut), _PAIRS)
        joined = clusters.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(crossing.select(F.col("a").alias("u"), F.col("b").alias("v")))
        clusters = materialize(connected_components(joined), "joined-clusters")

    sized = clusters.join(members.select("node", "signature", "n_shingles"), "node")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    parts = F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    placed = sized.join(totals, "component").select(F.col("component").alias("bucket"), "node", "signature", F.explode(_block_pairs(block, parts)).alias("o")).select("bucket", "node", "signature", "o.part", "o.side")
    compared = placed.join(cluster_sets(source, clusters, shingle), "node").select("bucket", "part", "node", "side", "signature", "shingles")
    links = map_batches(_grouped(compared), _links(cut, lambda shared, united: 100 * shared >= percent * united), _PAIRS)
    components = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = rows.join(components, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _block_pairs(block: Column, parts: Column) -> Column:
    """The parts and sides of a row: part i * parts + j compares block i (side 0) with block j (side 2); where i = j all
    rows have side 1."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct((F.least(block, j) * parts + F.greatest(block, j)).alias("part"), F.when(j == block, 1).when(block < j, 0).otherwise(2).alias("side")))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component one row, that of the smallest id.

    Rows are linked by their texts whatever their ids: of rows that share the id the first read stays, and a row
    with null id stays only where all of its component have none. Rows without words all stay.
    """
    keyed, key = with_row_key(docs, "rows-to-link")
    found = near_dedup(keyed.select(F.col(key).alias("row_key"), F.col(text_col).alias("text")), shingle, percent, id_col="row_key", text_col="text")
    linked = found.select(F.col("doc_id").alias("row_key"), "component_id").join(keyed.select(F.col(key).alias("row_key"), F.col(id_col).cast("long").alias("own_id")), "row_key")
    best = linked.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "row_key")).alias("best"))
    return keyed.join(best.select(F.col("best.row_key").alias(key)), key, "left_semi").select(docs.columns)


def _grouped(members: DataFrame) -> DataFrame:
    return members.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
