"""Around the use of an API: import roots, contexts, windows of documents, review targets, reports and ordered phases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import relational as rel
from lodestone.streaming.progress import live

#: Packages whose import root has another name.
KNOWN_ROOTS = {"PyJWT": "jwt", "PyYAML": "yaml", "scikit-learn": "sklearn", "beautifulsoup4": "bs4", "Pillow": "PIL", "python-dotenv": "dotenv"}
#: Starts of lines that belong to a file's import block; words that speak of a context manager.
IMPORT_STARTS = ("import ", "from ", "use ", "mod ", "pub mod ", "package ", "#![", "#[", "extern crate ", "using ", "namespace ")
MANAGER_MARKS = ("context manager", "connect() as", "begin() as", "explicit transaction")
#: The order of a preview's phases, and change events that it shows.
PHASES, SHOWN_CHANGES = ("ast_scan", "scout", "patch", "done"), 6
#: Types that are no evidence by themselves, and types that call for action.
REVIEW_TYPES, ACTION_TYPES = ("migration_review", "impact_review"), ("removed", "renamed", "changed_signature")
WINDOW_CHARS, WINDOW_GAP, MOST_WINDOWS, CONTEXT_LIMIT, TARGET_LIMIT, RESPONSE_TTL = 900, 80, 4, 40, 80, 3600


def import_roots(packages: DataFrame, installed: DataFrame | None = None, package: str = "package") -> DataFrame:
    """package, root: the name, with dashes and underscores changed, known other names, and those of installed (package, root)."""
    name = F.col(package)
    known = tx.mapped({k.lower().replace("_", "-"): v for k, v in KNOWN_ROOTS.items()}, F.lower(F.translate(name, "_", "-")))
    roots = F.array(name, F.translate(name, "-", "_"), F.translate(name, "_", "-"), F.nullif(known, F.lit("")))
    rows = packages.select(package, F.explode(roots).alias("root"))
    if installed is not None:
        rows = rows.unionByName(packages.select(package).join(installed.select(package, "root"), package))
    return rows.where("root <> ''").distinct()


def usage_contexts(lines: DataFrame, matches: DataFrame, around: int = 2, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """file, line, api, context: the lines around the first matches (file, line, api). lines: file, line, text.

    Matches meet lines by (file, line) alone, so a long file is no single task.
    """
    first = matches.where("line > 0").select("file", F.col("line").cast("long").alias("line"), "api").distinct().orderBy("file", "line", "api").limit(limit)
    wanted = first.withColumn("_at", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)))
    near = lines.select("file", F.col("line").cast("long").alias("_at"), "text")
    found = wanted.join(near, ["file", "_at"]).groupBy("file", "line", "api").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_rows"))
    return found.select("file", "line", "api", F.array_join(F.transform("_rows", lambda r: F.coalesce(r["text"], F.lit(""))), "\n").alias("context"))


def term_windows(documents: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text", around: int = WINDOW_CHARS, gap: int = WINDOW_GAP, most: int = MOST_WINDOWS) -> DataFrame:
    """key, place, start, end, snippet: stretches around all occurrences of the stated terms, those at most gap apart
    joined, the first few of a document. start is the offset before the first character."""
    one = lambda t: documents.select(key, F.lit(len(t)).alias("_n"), F.posexplode(F.transform(F.split(F.lower(text), rf"\Q{t.lower()}\E", -1), F.length)).alias("_i", "_len"), F.length(text).alias("_all"))
    rows = None
    for t in dict.fromkeys(terms):
        upto = Window.partitionBy(key).orderBy("_i")
        part = one(t).withColumn("_at", F.sum("_len").over(upto) + F.col("_i") * F.col("_n")).withColumn("_last", F.lead("_i").over(upto).isNull()).where("not _last")
        part = part.select(key, F.greatest(F.lit(0), F.col("_at") - around).alias("start"), F.least("_all", F.col("_at") + F.col("_n") + around).alias("end"))
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > before + gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("place", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("place") <= most)
    spans = rows.groupBy(key, "place").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"))
    return spans.join(documents.select(key, text), key).select(key, "place", "start", "end", F.trim(F.substring(text, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).alias("snippet"))


def first_stage(stages: Sequence[DataFrame]) -> DataFrame:
    """The rows of the first of the stages that has any, with its stage."""
    rows = None
    for i, s in enumerate(stages):
        rows = s.withColumn("stage", F.lit(i)) if rows is None else rows.unionByName(s.withColumn("stage", F.lit(i)))
    least = rows.agg(F.min("stage").alias("stage"))  # one row
    return rows.join(F.broadcast(least), "stage")


def review_targets(usages: DataFrame, package: str = "package", usage: str = "usage", limit: int = TARGET_LIMIT) -> DataFrame:
    """package, usage, place: what to review where no change is known. Usages below the package's own name, or all where
    there are none; the more specific instead of its prefixes; most dots, most slashes, then longest, first."""
    rows = usages.select(package, usage).where((F.col(usage) != "") & (F.col(usage) != F.col(package))).distinct()
    own = F.startswith(F.col(usage), F.concat(package, F.lit("."))) | F.startswith(F.col(usage), F.concat(package, F.lit("/")))
    rows = rows.withColumn("_own", own)
    owning = rows.where("_own").select(package).distinct().withColumn("_has", F.lit(True))
    rows = rows.join(owning, package, "left").where("_own or _has is null").withColumn("_key", F.concat(package, F.lit("\0"), usage))
    rows = rows.join(rel.prefer_specific(rows, "_key", [".", "/"]), "_key", "left_semi")
    order = [F.desc(F.size(F.split(usage, r"\."))), F.desc(F.size(F.split(usage, "/"))), F.desc(F.length(usage)), F.asc(usage)]
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(package).orderBy(*order)))
    return placed.where(F.col("place") <= limit).select(package, usage, "place")


def speculative_reviews(matches: DataFrame, changes: DataFrame, evidence: DataFrame) -> DataFrame:
    """file, skip: whether a file's matches (file, type, api) are reviews that nothing bears out.

    changes (type, api) that call for action decide where there are any, else evidence (api). Equal APIs and those above
    or below one another are related; the relation is two equi-joins on prefixes.
    """
    acting = changes.where(F.col("type").isin(*ACTION_TYPES) & (F.col("api") != "")).select("api").distinct()
    has = acting.agg((F.count(F.lit(1)) > 0).alias("_has"))  # one row
    proof = acting.withColumn("_acts", F.lit(True)).unionByName(evidence.where("api <> ''").select("api").distinct().withColumn("_acts", F.lit(False)))
    proof = proof.join(F.broadcast(has), F.col("_acts") == F.col("_has")).select("api")
    above = lambda c: F.concat(rel.prefixes(F.col(c), "."), F.array(c))
    own = matches.where("api <> ''").select("api").distinct()
    down = own.select("api", F.explode(above("api")).alias("_other")).join(proof.withColumnRenamed("api", "_other"), "_other").select("api")
    up = proof.select(F.explode(above("api")).alias("api")).join(own, "api").select("api")
    related = down.unionByName(up).distinct().withColumn("_related", F.lit(True))
    rows = matches.join(related, "api", "left")
    return rows.groupBy("file").agg((F.every(F.coalesce(F.col("type").isin(*REVIEW_TYPES), F.lit(False))) & ~F.some(F.coalesce("_related", F.lit(False)))).alias("skip"))


def mentions_context_manager(text: Column) -> Column:
    said = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    found = said.rlike(r"\bwith\s+[^.\n]{0,120}\bas\b")
    for mark in MANAGER_MARKS:
        found = found | F.contains(said, F.lit(mark))
    return found


def import_context(content: Column, most: int = 80) -> Column:
    """The lines at the top that are blank or import-like, and the line after them."""
    said = F.transform(F.split(content, "\n"), lambda line: F.struct(line.alias("line"), F.trim(line).alias("t")))
    starts = lambda t: (t == "") | F.exists(F.array(*map(F.lit, IMPORT_STARTS)), lambda s: F.startswith(t, s))
    n = F.aggregate(F.transform(said, lambda x: starts(x["t"])), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, ok: F.struct((a["n"] + (a["on"] & ok).cast("int")).alias("n"), (a["on"] & ok).alias("on")), lambda a: a["n"])
    kept = F.slice(F.transform(said, lambda x: x["line"]), 1, F.when(n > 0, F.least(n + 1, F.lit(most))).otherwise(0))
    return F.regexp_replace(F.array_join(kept, "\n"), r"\s+\z", "")


def impact_report(changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """report, text: code that changed, code it reaches by depth, module-level code last, in order of ids.

    changed: report, id, file, name, parent, kind, start_line, end_line, source; impacted has depth, reason and
    attributes (array of string) besides. A report is one text, so it is bounded by what a reader takes.
    """
    named = F.coalesce(F.nullif("name", F.lit("")), F.lit("module_level"))
    head = F.format_string("File: %s, function: %s, lines %d-%d", F.col("file"), F.when(F.coalesce("parent", F.lit("")) != "", F.concat("parent", F.lit("."), named)).otherwise(named), "start_line", "end_line")
    uses = F.when(F.size("attributes") > 0, F.concat(F.lit("; uses return value attributes: ["), F.array_join("attributes", ", "), F.lit("]"))).otherwise("")
    block = lambda *more: F.concat_ws("\n", head, *more, "source", F.lit(""))
    module = F.col("kind") == "module_level"
    rows = changed.select("report", F.lit(0).alias("group"), "id", block().alias("block"))
    rows = rows.unionByName(impacted.select("report", F.when(module, 1 << 30).otherwise(F.col("depth")).alias("group"), "id", block(F.concat(F.lit("Note: "), F.col("reason"), uses)).alias("block")))
    title = F.when(F.col("group") == 0, "=== CHANGED CODE ===").when(F.col("group") == 1 << 30, "=== MODULE-LEVEL CODE AFFECTED ===")
    title = title.otherwise(F.format_string("=== %s (depth %d) ===", F.when(F.col("group") == 1, "DIRECTLY AFFECTED").otherwise("INDIRECTLY AFFECTED"), "group"))
    inside = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "block"))), lambda x: x["block"]), "\n")
    groups = rows.groupBy("report", "group").agg(inside("id").alias("block")).select("report", "group", F.concat(title, F.lit("\n"), F.col("block")).alias("block"))
    return groups.groupBy("report").agg(F.rtrim(F.regexp_replace(inside("group"), r"\s+\z", "")).alias("text"))


def ordered_phases(events: DataFrame, session: str = "session_id", phase: str = "phase", order: str = "ord", change: Column | None = None, most: int = SHOWN_CHANGES) -> DataFrame:
    """events with place: by phase, then order, of each session; unknown phases go, and of the rows that are changes only
    the first few stay."""
    rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col(phase))
    by = Window.partitionBy(session).orderBy("_rank", order)
    rows = events.withColumn("_rank", rank).where("_rank > 0").withColumn("_change", F.lit(False) if change is None else F.coalesce(change, F.lit(False)))
    nth = F.sum(F.col("_change").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_nth", nth).where(~F.col("_change") | (F.col("_nth") <= most)).withColumn("place", F.row_number().over(by)).drop("_rank", "_change", "_nth")


def cached_responses(requests: DataFrame, cache: DataFrame, now: Column, ttl: int = RESPONSE_TTL) -> DataFrame:
    """requests (key, ...) with response: the newest of the cache (key, created, response) that is still alive, or null."""
    alive = cache.where(live(F.col("created"), now, ttl)).groupBy("key").agg(F.max_by("response", "created").alias("response"))
    return requests.join(alive, "key", "left")
