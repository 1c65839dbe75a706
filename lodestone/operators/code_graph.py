"""Call edges and impact of changed lines over code nodes, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.intervals import innermost

LAST_PART = r"([^.]*)$"
#: Fixed value: why a node is hit that an editor's locations refer to.
LOCATION = "lsp reference/call hierarchy"


def definitions(nodes: DataFrame) -> DataFrame:
    """sym, target, def_file: every name that a call may resolve to."""
    full = F.concat_ws(".", "parent", "name")
    names = F.array_distinct(F.filter(F.concat("defines", F.array("name", full)), lambda x: x.isNotNull() & (x != "")))
    return nodes.select(F.explode(names).alias("sym"), F.col("id").alias("target"), F.col("file").alias("def_file"))


def call_edges(nodes: DataFrame) -> DataFrame:
    """source, target, call: each call with its best node: that of the whole name or its last part, in the same file
    if there is one, then the smallest id."""
    calls = nodes.select(F.col("id").alias("source"), F.col("file"), F.explode("calls").alias("call"))
    either = F.array_distinct(F.array("call", F.regexp_extract("call", LAST_PART, 1)))
    refs = calls.select("source", "file", "call", F.explode(either).alias("sym"))
    best = graph.resolve_references(refs, definitions(nodes).withColumnRenamed("def_file", "file"), "sym", ["source", "call"], "file", "target")
    return best.select("source", "target", "call")


def exported(nodes: DataFrame) -> DataFrame:
    """node, sym: the names under which others use a node."""
    full = F.concat_ws(".", "parent", "name")
    names = F.when(F.col("context_type") == "module_level", F.col("defines")).otherwise(F.array_distinct(F.filter(F.array("name", full), lambda x: x.isNotNull())))
    return nodes.select(F.col("id").alias("node"), F.explode(names).alias("sym"))


def nodes_at(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """file, line, node: the innermost node of each (file, line); module-level code only where nothing else holds the line."""
    spans = nodes.select("file", F.col("start_line").cast("long").alias("s"), F.col("end_line").cast("long").alias("e"), "id", (F.col("context_type") == "module_level").alias("loose"))
    points = places.select("file", "line").distinct()
    inner = innermost(points, F.col("line"), spans.where("not loose"), ["file"], "s", "e", ["file", "line"], ["id"])
    outer = innermost(points, F.col("line"), spans.where("loose"), ["file"], "s", "e", ["file", "line"], ["id"]).join(inner, ["file", "line"], "left_anti")
    found = inner.unionByName(outer)
    return found.join(spans, ["file", "s", "e"]).groupBy("file", "line").agg(F.min("id").alias("node"))


def changed_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """node of each changed (file, line)."""
    return nodes_at(nodes, changes).select("node").distinct()


def location_impacts(nodes: DataFrame, locations: DataFrame, changed: DataFrame) -> DataFrame:
    """node, depth, impact_reason, affected_attributes of editor locations (origin, file, line) that refer to a changed
    node (changed: node): the code around a location is hit at depth 1, by value if it uses what the origin returns."""
    here = locations.join(changed.select(F.col("node").alias("origin")), "origin", "left_semi").join(nodes_at(nodes, locations), ["file", "line"]).select("origin", "node").distinct()
    outside = here.join(changed.select("node"), "node", "left_anti")
    names = exported(nodes).select(F.col("node").alias("origin"), F.regexp_extract("sym", LAST_PART, 1).alias("sym")).distinct()
    used = outside.join(names, "origin").join(_used_attributes(nodes), ["node", "sym"]).groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("attrs")))).alias("affected_attributes"))
    rows = outside.select("node").distinct().join(used, "node", "left")
    by_value = F.size(F.coalesce("affected_attributes", F.array().cast("array<string>"))) > 0
    return rows.select("node", F.lit(1).alias("depth"), F.when(by_value, graph.USES_VALUE).otherwise(LOCATION).alias("impact_reason"), F.coalesce("affected_attributes", F.array().cast("array<string>")).alias("affected_attributes"))


def _used_attributes(nodes: DataFrame) -> DataFrame:
    """node, sym, attrs: what a node uses of the values that calls of sym return, by the name's last part."""
    rows = nodes.select(F.col("id").alias("node"), F.explode("usage").alias("u")).select("node", F.regexp_extract("u.origin", LAST_PART, 1).alias("sym"), "u.attr")
    return rows.groupBy("node", "sym").agg(F.collect_set("attr").alias("attrs"))


def impact(nodes: DataFrame, edges: DataFrame, changes: DataFrame, max_depth: int = 3) -> DataFrame:
    """node, depth, impact_reason, affected_attributes of what changed lines may break, without the changed nodes, in
    order of depth and id.

    Callers up to max_depth, level by level; users of a changed node's names at depth 1.
    """
    seeds = changed_nodes(nodes, changes)
    none = F.array().cast("array<string>")
    used = _used_attributes(nodes)
    names = exported(nodes).select(F.col("node").alias("target"), F.regexp_extract("sym", LAST_PART, 1).alias("sym")).distinct()
    by_value = edges.select("source", "target").distinct().join(names, "target").join(used.withColumnRenamed("node", "source"), ["source", "sym"]).groupBy("source", "target").agg(F.array_distinct(F.flatten(F.collect_list("attrs"))).alias("attrs"))
    hit = graph.reverse_reach(edges, seeds, max_depth)
    # The edge by which a level is reached carries what its caller uses of the value.
    levels = seeds.select(F.col("node").alias("target"), F.lit(0).alias("at")).unionByName(hit.select(F.col("node").alias("target"), F.col("depth").alias("at"))).where(F.col("at") < max_depth)
    steps = levels.join(edges.select("source", "target").distinct(), "target").join(by_value, ["source", "target"], "left").join(seeds.select(F.col("node").alias("source")), "source", "left_anti")
    calls = steps.select(F.col("source").alias("node"), F.lit(0).alias("stage"), (F.col("at") + 1).alias("depth"), F.coalesce("attrs", none).alias("affected_attributes"))
    calls = calls.withColumn("impact_reason", F.when(F.size("affected_attributes") > 0, graph.USES_VALUE).otherwise("calls changed function"))
    symbols = exported(nodes).join(seeds, "node", "left_semi").select(F.col("sym"), F.col("node").alias("seed")).distinct()
    users = nodes.select(F.col("id").alias("node"), "context_type", F.explode("references").alias("sym")).join(symbols, "sym").where("node <> seed").join(seeds, "node", "left_anti")
    users = users.join(used, ["node", "sym"], "left").select("node", F.lit(1).alias("stage"), F.lit(1).alias("depth"), F.coalesce("attrs", none).alias("affected_attributes"), F.when(F.col("context_type") == "module_level", "module level dependency").otherwise("uses defined symbol").alias("impact_reason"))
    adds = calls.unionByName(users).withColumn("stage", F.struct("stage", "depth", "impact_reason"))
    return graph.impacts(adds, "node", "stage", "impact_reason", "depth", "affected_attributes").orderBy("depth", "node")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, files."""
    counts = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file").alias("files"))
    return counts.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True)).select("nodes", "edges", "files")


def stale_files(files: DataFrame, cached: DataFrame, version: int) -> DataFrame:
    """Files whose (path, mtime) isn't in the cache of this version: those to parse again."""
    return files.join(cached.where(F.col("cache_version") == version).select("path", "mtime"), ["path", "mtime"], "left_anti")


def matches_query(text: str, *columns: str) -> Column:
    """Case-insensitive substring search over several columns and arrays joined."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))
