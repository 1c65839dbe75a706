"""Retrieval of evidence for API changes: sections of change logs, scored chunks of documents, supported changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.arrays import bound
from lodestone.functions.versions import version_in_window, version_tuple
from lodestone.operators import relational as rel
from lodestone.operators.positions import NAMES
from lodestone.operators.references import path_versions_relevant
from lodestone.operators.scan import text_places
from lodestone.operators.semantics import profile_points, semantic_score
from lodestone.sources.storage import stored

CHUNK_CHARS, MAX_CHUNKS, CHANGELOG_CHARS, LEAST_SCORE = 1800, 14, 30_000, 10
#: Chunks of one address by its kind of document, and the score that the kind brings.
KIND_CAPS = {"migration_guide": 6, "release_notes": 5, "api_docs": 2, "registry": 2, "reference": 2}
KIND_SCORES = {"migration_guide": 8, "release_notes": 6, "api_docs": 3}
#: Words of change that each add to a chunk's score.
CHANGE_TERMS = (
    "removed", "remove", "deprecated", "deprecation", "renamed", "replaced", "replacement", "instead", "use ", "no longer", "breaking", "backwards incompatible", "migration", "upgrade",
    "changed signature", "signature", "requires", "must",
)
#: Least points of methods or meanings that let a chunk, or a registry's page, pass; those of a sure chunk.
METHOD_PASS, MEANING_PASS, METHOD_SURE, REGISTRY_MEANING = 35, 18, 80, 36
#: Words that bear out a removal; matched terms that say nothing of a meaning.
REMOVAL_WORDS = ("removed", "remove", "no longer", "deprecated", "deprecation", "expired")
GENERIC_MATCHES = ("project", "package", "breaking-change-section")


def _by_kind(values: dict[str, int], kind: Column, default: int) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))[kind], F.lit(default))


def chunks(references: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """references with chunk_index, content: paragraphs packed in order up to size characters. A paragraph inside a
    code fence stays with what opened the fence; a longer paragraph is a chunk of its own."""
    paragraphs = F.filter(F.split("content", r"\n[ \t]*\n"), lambda p: F.trim(p) != "")
    fences = lambda p: (F.length(p) - F.length(F.replace(p, F.lit("```"), F.lit("")))) / 3
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(acc: Column, p: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(p) + 2 <= size) | (fences(acc["open"]) % 2 == 1)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    packed = F.aggregate(paragraphs, start, pack, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    rest = [c for c in references.columns if c != "content"]
    return references.select(*rest, F.posexplode(packed).alias("chunk_index", "content"))


def search_terms(usages: DataFrame, usage: str = "usage") -> DataFrame:
    """term, strong: a usage, its last two and three parts, and its leaf if that has over three letters. Weak are terms
    that say too little, and names of packages."""
    whole = F.lower(usage)
    leaf = F.when((F.size(tx.name_parts(whole)) >= 2) & (F.length(F.element_at(tx.name_parts(whole), -1)) > 3), F.element_at(tx.name_parts(whole), -1))
    terms = F.filter(F.array(whole, tx.last_parts(whole, 2), tx.last_parts(whole, 3), leaf), lambda t: t.isNotNull() & (t != ""))
    roots = usages.select(F.get(F.filter(F.split(whole, r"[.:/]+"), lambda p: p != ""), F.lit(0)).alias("term")).distinct().withColumn("_root", F.lit(True))
    rows = usages.select(F.explode(F.array_distinct(terms)).alias("term")).distinct().join(roots, "term", "left")
    return rows.select("term", (F.col("_root").isNull() & ~tx.weak_term(F.col("term"))).alias("strong"))


def score_chunks(chunked: DataFrame, terms: DataFrame, versions: Sequence[str] = (), profiles: DataFrame | None = None, meanings: Sequence[str] = ()) -> DataFrame:
    """chunked with document_kind, score, matched_terms, strong_terms, method_score, semantic_score, evidence_confidence.

    Every term that a chunk (with title and address) contains adds 10 and a fifth of its length up to 8; change words,
    versions, methods (profiles: owner, method), meanings and the kind of document add theirs. A chunk passes that speaks
    of change and has a strong term, a method or a meaning in its own text; a registry's page needs more of the latter.
    Terms and methods are found where the chunks are read; terms hold a word.
    """
    keyed = stored(chunked.withColumn("_key", F.monotonically_increasing_id()).withColumn("document_kind", tx.document_kind(F.col("source"), F.col("title"), F.col("url"))), "keyed-chunks")
    rows = keyed.withColumn("_said", F.concat_ws(" ", "title", "url", "content"))
    found = text_places(rows.select("_key", F.lower("_said").alias("text")), "_key", "text", terms.select(F.col("term").alias("phrase")))
    found = found.select(F.col("phrase").alias("term"), F.col("key").alias("_key")).distinct().join(terms.distinct(), "term")
    weight = 10 + F.least(F.lit(8), F.floor(F.length("term") / 5).cast("int"))
    hits = found.groupBy("_key").agg(F.sum(weight).alias("_points"), F.array_sort(F.collect_set("term")).alias("matched_terms"), F.array_sort(F.collect_set(F.when(F.col("strong"), F.col("term")))).alias("strong_terms"))
    rows = rows.join(hits, "_key", "left")
    said, phrases = F.lower("_said"), F.array(*map(F.lit, meanings)) if meanings else F.array().cast("array<string>")
    count = lambda words: sum((F.contains(said, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    rows = rows.withColumn("semantic_score", semantic_score(F.col("content"), phrases)).withColumn("_whole_meaning", semantic_score(F.col("_said"), phrases))
    if profiles is None:
        rows = rows.withColumn("method_score", F.lit(0)).withColumn("_whole_method", F.lit(0))
    else:
        kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), tx.evidence_text(F.col(said)).alias("text")) for kind, said in (("said", "_said"), ("own", "content"))))
        points = profile_points(rows.select("_key", F.inline(kinds)).select(F.struct(F.col("_key").alias("id"), "kind").alias("key"), "text"), "key", "text", profiles)
        of = lambda kind: F.coalesce(F.sum(F.when(F.col("key.kind") == kind, F.col("points"))), F.lit(0))
        rows = rows.join(points.groupBy(F.col("key.id").alias("_key")).agg(of("own").alias("_own"), of("said").alias("_whole")), "_key", "left")
        rows = rows.withColumn("method_score", F.coalesce("_own", F.lit(0))).withColumn("_whole_method", F.coalesce("_whole", F.lit(0)))
    score = F.coalesce("_points", F.lit(0)) + 3 * count(CHANGE_TERMS) + 2 * count(versions) + F.col("_whole_method") + F.col("_whole_meaning") + _by_kind(KIND_SCORES, F.col("document_kind"), 0)
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn("matched_terms", F.coalesce("matched_terms", nothing)).withColumn("strong_terms", F.coalesce("strong_terms", nothing))
    method, meaning, strong = F.col("method_score"), F.col("semantic_score"), F.size("strong_terms") > 0
    listed = (F.col("document_kind") != "registry") | (method >= METHOD_SURE) | (meaning >= REGISTRY_MEANING)
    anchored = tx.has_migration_language(F.col("content")) & (strong | (method >= METHOD_PASS) | (meaning >= MEANING_PASS))
    matched = (F.size("matched_terms") > 0) | (F.col("_whole_method") > 0) | (F.col("_whole_meaning") > 0)
    rows = rows.withColumn("score", score.cast("int")).where(listed & anchored & matched & (F.col("score") >= LEAST_SCORE))
    level = F.when(method >= METHOD_SURE, "high").when(strong | (meaning >= MEANING_PASS) | (method >= METHOD_PASS), "medium").otherwise("low")
    return rows.select(*chunked.columns, "document_kind", "score", "matched_terms", "strong_terms", "method_score", "semantic_score", level.alias("evidence_confidence"))


def rank_chunks(scored: DataFrame, limit: int = MAX_CHUNKS) -> DataFrame:
    """The best chunks: repeats of an address and its first 160 characters once, then at most the kind's cap of an
    address, then the limit."""
    order = [F.desc("score"), F.asc("ref_index"), F.asc("chunk_index")]
    once = Window.partitionBy("url", F.substring("content", 1, 160)).orderBy(*order)
    distinct = scored.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return rel.rank_cap_topk(distinct, "url", order, _by_kind(KIND_CAPS, F.col("document_kind"), 3), limit, max(KIND_CAPS.values()))


#: A Markdown heading of a version, a version in a heading, the row below a heading of reStructuredText.
MD_VERSION, RST_VERSION, RST_ROW = r"^#{1,3}\s+(?:\[?v?|[Vv]ersion\s+)(\d+\.\d+(?:\.\d+)*)", r"v?(\d+\.\d+(?:\.\d+)*)", r"^[-=~^#*+]{3,}$"


def changelog_sections(documents: DataFrame, low: str, high: str, budget: int = 3 * CHANGELOG_CHARS, least_tail: int = 200) -> DataFrame:
    """doc, version, content, used: sections of change logs whose version lies between two, x.0.0 first, then the
    newest, while the budget of characters lasts; of a document without such a section its beginning, without a version.

    documents: doc, content and, if there is one, path: a file .rst has headings with a row of signs below them too.
    """
    rst = F.lower(F.coalesce("path", F.lit(""))).endswith(".rst") if "path" in documents.columns else F.lit(False)

    def version_at(lines: Column, i: Column) -> Column:
        line, row = F.rtrim(F.get(lines, i)), F.rtrim(F.coalesce(F.get(lines, i + 1), F.lit("")))
        underlined = rst & row.rlike(RST_ROW) & (F.abs(F.length(row) - F.length(line)) <= 4) & (F.length(line) >= 3)
        return F.coalesce(F.nullif(F.regexp_extract(line, MD_VERSION, 1), F.lit("")), F.when(underlined, F.nullif(F.regexp_extract(line, RST_VERSION, 1), F.lit(""))))

    def sections(lines: Column) -> Column:
        marked = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.struct(i.alias("at"), version_at(lines, i).alias("version")))
        return bound(F.filter(marked, lambda m: m["version"].isNotNull()), lambda heads: F.transform(heads, lambda h, j: cut(lines, heads, h, j)))

    def cut(lines: Column, heads: Column, h: Column, j: Column) -> Column:
        to = F.coalesce(F.get(heads, j + 1)["at"], F.size(lines))
        return F.struct(j.alias("section"), h["version"].alias("version"), F.array_join(F.slice(lines, h["at"] + 1, to - h["at"]), "\n").alias("content"))

    rows = documents.select("doc", F.explode(bound(F.split("content", "\n"), sections)).alias("s")).select("doc", "s.*")
    kept = rows.where(version_in_window(F.col("version"), F.lit(low), F.lit(high)))
    whole = documents.where("content is not null").join(kept.select("doc").distinct(), "doc", "left_anti")
    parts = version_tuple(F.col("version"))
    major = (F.size(parts) >= 3) & (F.get(parts, 1) == 0) & (F.get(parts, 2) == 0)
    kept = kept.withColumn("_minor", ~major).withColumn("_up", F.when(major, F.get(parts, 0)).otherwise(0)).withColumn("_down", F.array(*(-F.coalesce(F.get(parts, i), F.lit(0)) for i in range(3)))).withColumn("_length", F.length("content"))
    limited = rel.char_budget(kept, ["doc"], ["_minor", "_up", "_down", "section"], "_length", budget, least_tail)
    found = limited.select("doc", "version", F.substring("content", F.lit(1), F.col("used")).alias("content"), F.col("used").cast("long").alias("used"))
    start = F.substring("content", 1, CHANGELOG_CHARS)
    return found.unionByName(whole.select("doc", F.lit(None).cast("string").alias("version"), start.alias("content"), F.length(start).cast("long").alias("used")))


def rankable(references: DataFrame, low: str, high: str) -> DataFrame:
    """References that may be ranked: not the old version's documents, and at no address of a version outside the window."""
    old = F.coalesce("role", F.lit("")) == "old_api_docs" if "role" in references.columns else F.lit(False)
    return references.where(~old & path_versions_relevant(F.concat_ws(" ", "title", "url"), F.lit(low), F.lit(high)))


def fallback_allowed(prior: Column, review: Column) -> Column:
    """Whether a patch may go by what a model knows, by either flag; null counts as not set."""
    return F.coalesce(prior, F.lit(False)) | F.coalesce(review, F.lit(False))


def supported_changes(changes: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """The changes (type, old_api, new_api) that evidence (api, quote) bears out.

    No-op renames go; of an allow-list (api) that isn't empty, a change needs its API or one above it; its evidence
    speaks of it or of an API above or below it, in words of migration (of removal, for a removal), and names it.
    """
    real = changes.where(F.col("old_api").isNotNull() & ~((F.col("type") == "renamed") & (tx.api_name("old_api") == tx.api_name("new_api")))).withColumn("_id", F.xxhash64("type", "old_api", "new_api"))
    above = F.concat(rel.prefixes(F.col("old_api"), "."), F.array("old_api"))
    open_ = allowed.agg((F.count(F.lit(1)) == 0).alias("_open"))
    listed = real.select("_id", F.explode(above).alias("api")).join(allowed.select("api").distinct(), "api", "left_semi").select("_id", F.lit(True).alias("_listed")).distinct()
    real = real.join(F.broadcast(open_), F.lit(True)).join(listed, "_id", "left").where("_open or _listed")
    # Related in either direction: the prefixes of one meet the whole of the other.
    up = real.select("_id", "old_api", "type", F.explode(above).alias("api")).join(evidence, "api")
    down = evidence.select("quote", F.explode(rel.prefixes(F.col("api"), ".")).alias("old_api")).join(real.select("_id", "old_api", "type"), "old_api")
    related = up.select("_id", "old_api", "type", "quote").unionByName(down.select("_id", "old_api", "type", "quote"))
    said = tx.evidence_text(F.col("quote"))
    leaf = F.element_at(F.split("old_api", r"\."), -1)
    named = lambda c: F.rlike(said, F.concat(F.lit(r"(?<![\w.])\Q"), F.lower(c), F.lit(r"\E(?![\w.]*\w)")))
    names = F.array(F.col("old_api"), F.array_join(F.slice(F.split("old_api", r"\."), -2, 2), "."), F.when(F.length(leaf) >= 8, leaf))
    removal = (F.col("type") != "removed") | said.rlike("remov|delet|drop|no longer|gone")
    proof = related.where(tx.has_migration_language(F.col("quote")) & removal & F.exists(F.filter(names, lambda n: n.isNotNull()), named)).select("_id").distinct()
    return real.join(proof, "_id", "left_semi").select(*changes.columns)


def supporting_references(changes: DataFrame, references: DataFrame) -> DataFrame:
    """change_id, api, change_type, replacement, confidence, source_index, source, url, quote: the first reference that
    bears out each change.

    changes: change_id, type, old_api, new_api. references: ref_index, source, title, url, content, semantic_score,
    matched_terms, evidence_confidence. A reference that speaks of migration supports a change directly if it has one of
    the old API's names (for a removal, with a word of removal), else if it has one of the new API's and is known to be
    close in meaning. One that has an old name without support supports nothing. Names are looked for where the
    references are read, and only each change's first reference is read again for its quote.
    """
    raw = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "url", "content")))
    said = tx.evidence_text(raw)
    close = (F.coalesce("semantic_score", F.lit(0)) > 0) | F.exists(F.coalesce("matched_terms", F.array().cast("array<string>")), lambda t: (F.length(F.trim(t)) >= 4) & ~F.lower(F.trim(t)).isin(*GENERIC_MATCHES))
    removal = F.exists(F.array(*map(F.lit, REMOVAL_WORDS)), lambda w: F.contains(F.col("_text"), w))
    # Each text is normalised once; what is read of it after that is stored.
    told = stored(references.select("ref_index", said.alias("_text"), close.alias("_close")), "told-references")
    marked = told.where(tx.has_migration_language(F.col("_text"))).withColumn("_gone", removal)
    old, new = (F.transform(f(F.col(c)), tx.evidence_text) for f, c in ((tx.evidence_variants, "old_api"), (tx.replacement_variants, "new_api")))
    names = changes.select("change_id", "type", F.lit(True).alias("direct"), F.explode(old).alias("phrase")).unionByName(changes.select("change_id", "type", F.lit(False).alias("direct"), F.explode(new).alias("phrase")))
    names = stored(names.distinct(), "change-names")
    places = text_places(marked, "ref_index", "_text", names, NAMES).select("phrase", F.col("key").alias("ref_index")).distinct()
    flags = marked.select("ref_index", "_close", "_gone")
    pairs = names.join(places, "phrase").join(flags, "ref_index").groupBy("change_id", "ref_index").agg(
        F.max("direct").alias("direct"), F.first("type").alias("type"), F.first("_close").alias("_close"), F.first("_gone").alias("_gone")
    )
    supports = F.when(F.col("direct"), (F.col("type") != "removed") | F.col("_gone")).otherwise(F.col("_close"))
    first = pairs.where(supports).groupBy("change_id").agg(F.min(F.struct("ref_index", "direct")).alias("_first")).select("change_id", "_first.*")
    rows = first.join(changes, "change_id").join(references.drop("type").withColumn("_raw", raw), "ref_index")
    quote = tx.quote_of(F.col("_raw"), F.when(F.col("direct"), tx.evidence_variants(F.col("old_api"))).otherwise(tx.replacement_variants(F.col("new_api"))))
    return rows.select(
        "change_id", F.col("old_api").alias("api"), F.coalesce(F.nullif("type", F.lit("")), F.lit("migration_review")).alias("change_type"), F.coalesce("new_api", F.lit("")).alias("replacement"),
        F.coalesce(F.nullif("evidence_confidence", F.lit("")), F.lit("medium")).alias("confidence"), F.col("ref_index").alias("source_index"),
        tx.document_kind(F.col("source"), F.col("title"), F.col("url")).alias("source"), "url", quote.alias("quote"),
    )


def fallback_chunks(chunked: DataFrame, limit: int = 4) -> DataFrame:
    """Breaking sections of release notes and migration guides, for when no chunk names an API."""
    rows = chunked.withColumn("document_kind", tx.document_kind(F.col("source"), F.col("title"), F.col("url"))).where("document_kind in ('release_notes', 'migration_guide')")
    own = F.lower("content")
    score = F.when(own.rlike("breaking"), 20).otherwise(0) + F.when(own.rlike("removed|renamed"), 10).otherwise(0) + F.when(own.rlike("migrat|deprecat"), 15).otherwise(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "ref_index", "chunk_index").limit(limit).withColumn("evidence_confidence", F.lit("low"))
