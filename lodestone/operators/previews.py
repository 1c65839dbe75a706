"""Reports on scans and previews, decisions, blocks around matches, repair candidates and the layout of graphs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import relational as rel

#: Lines of module-level code, lines and characters of other blocks that stay whole; lines around a match.
MODULE_LINES, BLOCK_LINES, BLOCK_CHARS, AROUND = 90, 140, 14_000, 18
#: Files that a repair looks at.
REPAIR_FILES = 8
#: Radius of the first node of a layout, and the spread of the others.
INNER_RADIUS, SPREAD = 42, 95


def is_update_candidate(name: Column, current: Column, latest: Column) -> Column:
    """A named package with two versions that differ; unknown counts as a version."""
    said = [F.trim(F.coalesce(c, F.lit(""))) for c in (name, current, latest)]
    return (said[0] != "") & (said[1] != "") & (said[2] != "") & (said[1] != said[2])


def said_in(needle: str, *columns: str) -> Column:
    """Case-insensitive search over several columns; a blank search finds all."""
    wanted = needle.strip().lower()
    return F.lit(True) if not wanted else F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))


def scan_totals(files: DataFrame, matches: DataFrame, file: str = "file") -> DataFrame:
    """files_scanned, files_affected, total_matches."""
    hits = matches.groupBy(file).agg(F.count(F.lit(1)).alias("_n"))
    rows = files.select(file).distinct().join(hits, file, "left")
    return rows.agg(F.count(F.lit(1)).alias("files_scanned"), F.count("_n").alias("files_affected"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("total_matches"))


def preview_totals(files: DataFrame, session: str = "session_id") -> DataFrame:
    """session, total_files_changed, total_additions, total_deletions; files without a change count nowhere."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"total_{c}")
    return files.groupBy(session).agg(F.count_if(F.col("additions") + F.col("deletions") > 0).alias("total_files_changed"), total("additions"), total("deletions"))


def decision_payload(decisions: DataFrame, keys: Sequence[str], hunk: str = "hunk_id", decision: str = "decision") -> DataFrame:
    """keys, hunks: the decision of each hunk as sent, hunk=decision in order; pending counts as accepted."""
    sent = F.concat_ws("=", hunk, F.when(F.col(decision) == "rejected", "reject").otherwise("accept"))
    return decisions.groupBy(*keys).agg(F.array_sort(F.collect_list(sent)).alias("hunks"))


def layout(degrees: DataFrame, node: str, degree: str = "degree") -> DataFrame:
    """node, place, x, y: nodes by falling degree on a spiral of golden angles. Ranks come from partition totals."""
    placed = global_rank(degrees, [F.desc(degree), F.asc(node)]).withColumnRenamed("rank", "place")
    radius = F.lit(INNER_RADIUS) + F.sqrt("place") * SPREAD
    angle = F.col("place") * F.lit(math.pi * (3 - math.sqrt(5)))
    return placed.select(node, degree, "place", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def global_rank(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df with rank from 0 in a total order: ranges by order, their totals, and ranks inside them."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # Ranges run as the order does, so a partition's number is its place.
    totals = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(totals.select("_part", before.alias("_base"))), "_part").withColumn("rank", F.col("_base") + inside).drop("_part", "_n", "_base")


def first_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """The first rows of each key, limited before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def canonical_json(*columns: str) -> Column:
    """A row as JSON with its keys in order: what equal evidence is known by."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def distinct_evidence(evidence: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first of rows that are equal in all columns."""
    return rel.first_rows(evidence, [F.sha2(canonical_json(*columns), 256)], order)


def bounded_block(line: Column, start: Column, end: Column, kind: Column, chars: Column, n_lines: Column) -> Column:
    """start_line, end_line, context_type: a node's lines, or a slice around the match where the node is too long."""
    lines = end - start + 1
    loose = (kind == "module_level") & (lines > MODULE_LINES)
    long = loose | (lines > BLOCK_LINES) | (chars > BLOCK_CHARS)
    radius = F.when(loose, max(AROUND, min(45, MODULE_LINES // 2))).otherwise(max(12, min(45, BLOCK_LINES // 2)))
    return F.struct(
        F.when(long, F.greatest(F.lit(1), line - radius)).otherwise(start).alias("start_line"),
        F.when(long, F.least(n_lines, line + radius)).otherwise(end).alias("end_line"),
        F.when(long, F.concat(kind, F.lit("_slice"))).otherwise(kind).alias("context_type"),
    )


def changed_lines(matches: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """file, lines: distinct positive lines in order."""
    return matches.where(F.col(line) > 0).groupBy(file).agg(F.array_sort(F.collect_set(F.col(line).cast("long"))).alias("lines"))


def repair_candidates(errors: DataFrame, changed: DataFrame, session: str = "session_id", limit: int = REPAIR_FILES) -> DataFrame:
    """session, file, line: files of error locations first (session, file, line, ord), then changed files (session,
    file, ord) at line 1; each once, the first few of a session."""
    rows = errors.select(session, "file", F.col("line").cast("long").alias("line"), F.struct(F.lit(0).alias("s"), F.col("ord").cast("long").alias("o")).alias("at"))
    rows = rows.unionByName(changed.select(session, "file", F.lit(1).cast("long").alias("line"), F.struct(F.lit(1).alias("s"), F.col("ord").cast("long").alias("o")).alias("at")))
    return first_in_order(rel.first_rows(rows, [session, "file"], ["at"]), [session], ["at"], limit).select(session, "file", "line")


def expanded_matches(matches: DataFrame, impacts: DataFrame, limit_depth: int = 2) -> DataFrame:
    """matches (file, start_line, type, id) and, as impact_review, the nodes (file, start_line, node, depth) they reach;
    of equal keys the match stays."""
    added = impacts.where(F.col("depth") <= limit_depth).select("file", "start_line", F.lit("impact_review").alias("type"), F.col("node").alias("id"), F.lit(1).alias("_stage"))
    rows = matches.select("file", "start_line", "type", "id", F.lit(0).alias("_stage")).unionByName(added)
    return rel.first_rows(rows, ["file", "start_line", "type", "id"], ["_stage"]).select("file", "start_line", "type", "id", (F.col("_stage") == 1).alias("added"))


def section_ends(sections: DataFrame, ends: DataFrame, keys: Sequence[str], start: str, last: str) -> DataFrame:
    """keys, section_start, section_end: a section ends where the next begins, the last one at the end."""
    after = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return sections.withColumn("_next", after).join(ends, list(keys)).select(*keys, F.col(start).alias("section_start"), F.coalesce("_next", last).alias("section_end"))


def paragraphs(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_start, line_end, start, end: runs of lines that aren't blank, with offsets in characters."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    blank = F.col("line").rlike(r"^\s*$")
    rows = lines.select(key, "pos", blank.alias("blank"), F.coalesce(F.sum(F.length("line") + 1).over(upto), F.lit(0)).alias("at"), F.length("line").alias("n"))
    rows = rows.withColumn("run", F.coalesce(F.sum(F.col("blank").cast("int")).over(upto), F.lit(0))).where("not blank")
    return rows.groupBy(key, "run").agg((F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"), F.min("at").alias("start"), F.max(F.col("at") + F.col("n")).alias("end")).drop("run")


def set_changes(a: Column, b: Column) -> Column:
    """gone, both_sets, either: what only a has, what both have, what any has."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("gone"), F.array_sort(F.array_intersect(a, b)).alias("both_sets"), F.array_sort(F.array_union(a, b)).alias("either"))


def ordered_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, values: the distinct values of a key in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values")).select(key, F.size("values").cast("bigint").alias("n"), "values")
