"""The trie of conversation prefixes, by an LCP-aware mergesort of turn sequences.

A conversation is a path: 16 bytes for each turn (of the SHA-256 of its role and text), in order. Equal paths are united
first, so copies cost one row. Tasks sort what they hold into runs, in which every path carries the number of turns that
it shares with the one before it (its LCP). Runs are dealt by ranges of paths and each range merges its slices of them
with a loser tree: two paths are compared by the LCPs that they carry with the last path given out, and only where these
are equal by their turns from there on, so turns known to be shared are not compared again. The merged stream goes over
a stack, the open path: an LCP of l closes all nodes deeper than l, and a closed node is finished.

The nodes of a range's first and last path may go on in other ranges. They are handed on with what they have gathered,
as paths of their own, and the next round does the same with those alone; a round leaves two paths for each range, and
the last has one range. A finished node's children are given out with it, so they know their parent; children of nodes
that were handed on meet their parent in a join through salted pairs.

The digest of the conversations that end in a node is made of sorted ids; where an id range ends within a node, pieces
of its list are put together one after another, so a path that a third of all conversations have is no list in memory.

Two different turns, paths or nodes of n are confused with a chance of n * n / 2**129.

Defined cases: turns are ordered by turn (null first), then by digest; null role or text is empty; repeated rows are
turns of their own; rows of a null conv_id are no conversation and are left out; a conversation that is rebuilt without
turns is a member of the root; an empty table gives no rows. Other columns are not read. A conversation's path is one
value (24 bytes a turn), so one task holds it; texts do not leave the task that reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_schema, map_batches, materialize, spread_join

#: Bytes of a turn in a path.
TURN = 16
#: Bytes of paths that a range should have, and handed-on paths that one last range may have.
RANGE_BYTES, LAST = 8 << 20, 4096
#: Ids that one piece of a list has at most.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

_ENDS = "path1 long, path2 long, whole boolean, n long, conv_id long, part int, piece long, said string"
_PATHS = "path binary, sizes array<int>, conv_id long, n long, ends string, gathered array<struct<n:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"
_RUNS = _PATHS + ", run long, place long, lcp int"
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OUT = "handed boolean, parent1 long, parent2 long, self1 long, self2 long, " + _NODE + ", path binary, sizes array<int>, gathered array<struct<n:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"


def turn_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns array<struct<turn, id, bytes>> in order; id: 32 hex digits."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * TURN)
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), said.alias("id"), F.octet_length(text).alias("bytes"))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), row.alias("said"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, path, sizes: the first h turns of conversation c - c % group, then those of c after its first h; h = crc32(c) % heads."""
    head = conversations.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = conversations.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), F.expr(f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {heads} AS INT)").alias("h"))
    none = F.expr("slice(turns, 1, 0)")
    tail = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    turns = F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), tail)
    joined = own.join(head, "base", "left").select("conv_id", turns.alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("path"), F.col("turns.bytes").alias("sizes"))


def path_ends(paths: DataFrame) -> DataFrame:
    """conv_id (the smallest), n and ends (the digest of all ids, ascending) for each distinct path."""
    spark = paths.sparkSession
    schema = arrow_schema(_ENDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, open_key, ids, edge, piece = None, [], None, [], True, 0

        def given(last: bool) -> dict:
            said = ",".join(map(str, ids))
            whole = not edge and not last and not piece
            return dict(zip(schema.names, (*open_key, whole, len(ids), ids[0], part, piece, hashlib.sha256(said.encode()).hexdigest() if whole else said), strict=True))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("path1", "path2", "conv_id", "part"))
            for a, b, conv, part in zip(*columns, strict=True):
                if (a, b) != open_key:
                    if ids:
                        out.append(given(False))
                        edge = False
                    open_key, ids, piece = (a, b), [], 0
                elif len(ids) == PIECE:
                    # An unfinished list is not known to be whole: its pieces are put together afterwards.
                    edge_was, edge = edge, True
                    out.append(given(False))
                    edge, ids, piece = edge_was, [], piece + 1
                ids.append(conv)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if ids:
            yield pa.RecordBatch.from_pylist([given(True)], schema)

    keyed = paths.select(F.xxhash64("path").alias("path1"), F.xxhash64(F.lit("path"), "path").alias("path2"), "conv_id")
    parts = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(parts, "path1", "path2", "conv_id").sortWithinPartitions("path1", "path2", "conv_id")
    listed = materialize(map_batches(ordered.withColumn("part", F.spark_partition_id()), run, _ENDS), "path-ends")
    whole = listed.where("whole").select("conv_id", "n", F.col("said").alias("ends"))

    digest = arrow_schema("path1 long, path2 long, ends string")

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for a, b, said in zip(*(batch.column(c).to_pylist() for c in ("path1", "path2", "said")), strict=True):
                if (a, b) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(said.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, x, strict=True)) for x in out], digest)
        if key:
            yield pa.RecordBatch.from_pylist([dict(zip(digest.names, (*key, sha.hexdigest()), strict=True))], digest)

    pieces = listed.where("NOT whole")
    order = ("path1", "path2", "part", "piece")
    digests = map_batches(pieces.repartition("path1", "path2").sortWithinPartitions(*order).select("path1", "path2", "said"), united, "path1 long, path2 long, ends string")
    counts = pieces.groupBy("path1", "path2").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    return whole.unionByName(counts.join(digests, ["path1", "path2"]).select("conv_id", "n", "ends"))


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that the paths have in common at their beginning, known of which are known to be."""
    at, most = known * TURN, min(len(a), len(b))
    while at < most and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


class Run:
    """A sorted run: paths and, for each, the LCP with the one before."""

    __slots__ = ("at", "lcp", "lcps", "paths", "rows")

    def __init__(self) -> None:
        self.paths, self.lcps, self.rows, self.at, self.lcp = [], [], [], 0, 0

    def path(self) -> bytes | None:
        return self.paths[self.at] if self.at < len(self.paths) else None

    def forward(self) -> None:
        self.at += 1
        self.lcp = self.lcps[self.at] if self.at < len(self.paths) else -1


def _wins(a: Run, b: Run) -> bool:
    """Whether a's path comes first. Both carry LCPs with the last path given out; the loser's becomes that with the winner."""
    if b.lcp != a.lcp:
        return a.lcp > b.lcp  # the one that shares more with the last is smaller, and the other's LCP holds for it too
    if a.lcp < 0:
        return True
    x, y = a.path(), b.path()
    lcp = shared_turns(x, y, a.lcp)
    first = x[lcp * TURN :] <= y[lcp * TURN :] if lcp * TURN < min(len(x), len(y)) else len(x) <= len(y)
    if first:
        b.lcp = lcp
    else:
        a.lcp = lcp
    return first


def merged(runs: list[Run]) -> Iterator[tuple[int, bytes, object]]:
    """(LCP with the path before, path, row) of all runs in order, from a tree of losers."""
    size = 1
    while size < len(runs):
        size *= 2
    done = Run()
    done.lcp = -1
    leaves = [*runs, *[done] * (size - len(runs))]
    for r in runs:
        r.lcp = 0 if r.paths else -1
    losers = [done] * size
    winners = [done] * size + leaves
    for i in range(size - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if _wins(a, b) else (b, a)
    home = {id(r): size + i for i, r in enumerate(leaves)}
    best = winners[1]
    while best.lcp >= 0:
        yield best.lcp, best.path(), best.rows[best.at]
        best.forward()
        i = home[id(best)] // 2
        while i:
            if not _wins(best, losers[i]):
                best, losers[i] = losers[i], best
            i //= 2


@dataclass
class Node:
    """An open node: what is known of its subtree so far. rows: its finished children, which wait for its smallest member."""

    size: int = 0
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    rows: list = field(default_factory=list)

    def member(self, n: int, least: int | None) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def node_key(path: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(path)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def finished_nodes(stream: Iterator[tuple[int, bytes, dict]], alone: bool) -> Iterator[dict]:
    """Rows of _OUT: nodes whose members all are in the stream, and the paths to hand on (none where the stream is all there is)."""
    stack: list[Node] = []
    path, first, first_kept, shared = b"", None, [], 0

    def close(depth: int, border: bool) -> Iterator[dict]:
        """Close the deepest open node, which has this depth."""
        node = stack.pop()
        if border:
            yield from given(node, None, path[: depth * TURN])
            return
        if not node.children:
            node.leaves += 1
        node.saved += (node.n - 1) * node.size if depth else 0
        key = node_key(path[: depth * TURN])
        yield from given(node, node.least, None)
        row = {"handed": False, "self1": key[0], "self2": key[1], "conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.ends or NOTHING}
        if stack:
            above = stack[-1]
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.rows.append(row)
        else:
            yield row

    def given(node: Node, parent: int | None, at: bytes | None) -> Iterator[dict]:
        """The finished children of a node that closes: with their parent, or with its key."""
        key = node_key(at) if at is not None and node.rows else (None, None)
        for row in node.rows:
            yield row | {"parent1": key[0], "parent2": key[1], "parent_conv_id": parent}
        node.rows = []

    def state(node: Node) -> dict:
        return {"n": node.n, "least": node.least, "children": node.children, "leaves": node.leaves, "saved": node.saved, "ends": node.ends}

    sizes: list[int] = []
    for lcp, new, row in stream:
        if first is None:
            first, shared = (new, row["sizes"]), len(new) // TURN
        while len(stack) > lcp + 1:
            depth = len(stack) - 1
            border = not alone and depth <= shared
            if border:
                # A node of the first path: it may have members in the range before this one.
                first_kept.append(state(stack[-1]))
            yield from close(depth, border)
        shared = min(shared, lcp) if stack else shared
        path, sizes = new, row["sizes"]
        depth = len(path) // TURN
        while len(stack) <= depth:
            at = len(stack)
            stack.append(Node(size=sizes[at - 1] if at else 0))
        if row["gathered"]:
            for node, own in zip(stack, row["gathered"], strict=True):
                node.member(own["n"], own["least"])
                node.children, node.leaves, node.saved, node.ends = node.children + own["children"], node.leaves + own["leaves"], node.saved + own["saved"], own["ends"] or node.ends
        else:
            for node in stack:
                node.member(row["n"], row["conv_id"])
            stack[-1].ends = row["ends"]
    if not stack:
        return
    if alone:
        while stack:
            yield from close(len(stack) - 1, False)
        return
    last = [state(node) for node in stack]
    nothing = state(Node())
    if first_kept:
        # The part of the first path below what it shares with the last one.
        held = [nothing] * (len(first[0]) // TURN + 1 - len(first_kept)) + first_kept[::-1]
        yield {"handed": True, "path": first[0], "sizes": first[1], "gathered": held}
    yield {"handed": True, "path": path, "sizes": sizes, "gathered": last}
    while stack:
        yield from close(len(stack) - 1, True)


def sorted_runs(paths: DataFrame) -> DataFrame:
    """paths with run, place and lcp: each batch of a task is a sorted run."""
    schema = arrow_schema(_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            keys = batch.column("path").to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            lcps = [0, *(shared_turns(keys[a], keys[b]) for a, b in pairwise(order))]
            table = batch.select([c for c in schema.names[:-3]]).take(pa.array(order))
            part = batch.column("part")[0].as_py()
            own = [pa.array([part * (1 << 31) + number] * len(order), pa.int64()), pa.array(range(len(order)), pa.int64()), pa.array(lcps, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(table.columns, schema, strict=False)] + own, schema=schema)

    return map_batches(paths.withColumn("part", F.spark_partition_id().cast("long")), run, _RUNS)


def merge_ranges(runs: DataFrame, ranges: int) -> DataFrame:
    """_OUT of all ranges of paths."""
    schema = arrow_schema(_OUT)
    alone = ranges == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Run] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = found.setdefault(row["run"], Run())
                own.paths.append(row["path"])
                own.lcps.append(row["lcp"])
                own.rows.append(row)
        out: list[dict] = []
        for row in finished_nodes(merged(list(found.values())), alone):
            out.append(row)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    # Within a run the places stay in order, so its LCPs hold for what a range gets of it.
    dealt = runs.repartition(1) if alone else runs.repartitionByRange(ranges, "path")
    return map_batches(dealt.sortWithinPartitions("run", "place"), run, _OUT)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of rows of path, sizes, conv_id, n, ends (distinct paths)."""
    node = [c.split()[0] for c in _NODE.split(", ")]
    nodes, orphans = [], []
    now = paths.withColumn("gathered", F.lit(None).cast("array<struct<n:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>>"))
    last = False
    while True:
        runs = materialize(sorted_runs(now), "trie-runs")
        count, size = runs.agg(F.count(F.lit(1)), F.sum(F.octet_length("path") + 64)).first()
        last = count <= LAST or last
        ranges = 1 if last else max(2, min(-(-size // RANGE_BYTES), count // 16), min(count // 64, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        out = materialize(merge_ranges(runs, ranges), "trie-nodes")
        done = out.where("NOT handed")
        nodes.append(done.where("parent1 IS NULL"))
        orphans.append(done.where("parent1 IS NOT NULL"))
        if last:
            break
        now = out.where("handed").select("path", "sizes", F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("ends"), "gathered")
    complete, waiting = nodes[0], orphans[0]
    for x in nodes[1:]:
        complete = complete.unionByName(x)
    for x in orphans[1:]:
        waiting = waiting.unionByName(x)
    # Only nodes that were handed on have such children: those that the rounds after the first finished.
    borders = [x for pair in zip(nodes[1:], orphans[1:], strict=True) for x in pair]
    if not borders:
        return complete.select(*node)
    parents = borders[0]
    for x in borders[1:]:
        parents = parents.unionByName(x)
    parents = parents.select(F.col("self1").alias("parent1"), F.col("self2").alias("parent2"), F.col("conv_id").alias("parent"))
    adopted = spread_join(waiting, parents, ["parent1", "parent2"], F.xxhash64("self1", "self2")).withColumn("parent_conv_id", F.col("parent"))
    return complete.select(*node).unionByName(adopted.select(*node))


def prefix_trie(turns: DataFrame, group: int = 5, heads: int = 9, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node of the rebuilt conversations."""
    conversations = materialize(turn_paths(turns, conv_col, turn_col, role_col, text_col), "conversations")
    paths = materialize(rebuilt(conversations, group, heads), "paths")
    distinct = paths.join(path_ends(paths), "conv_id").select("path", "sizes", "conv_id", "n", "ends")
    return trie(distinct)
