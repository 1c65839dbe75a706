"""Where evidence may lie: candidate paths and addresses, their scores, pages that are none, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.versions import candidate_versions, version_in_window, version_tuple, versions_in_text
from lodestone.operators import relational as rel

#: Paths under which projects keep change logs, and those of a version, {v}.
CHANGELOG_NAMES = (
    "CHANGELOG.md", "CHANGELOG.rst", "CHANGELOG.txt", "CHANGES.md", "CHANGES.rst", "CHANGES.txt", "NEWS.md", "NEWS.rst", "NEWS.txt", "HISTORY.md", "HISTORY.rst", "RELEASES.md", "RELEASE_NOTES.md",
    "MIGRATION.md", "MIGRATING.md", "UPGRADE.md", "UPGRADING.md", "docs/CHANGELOG.md", "docs/changelog.md", "docs/changes.md", "docs/release-notes.md", "docs/release_notes.md", "docs/migration.md",
    "docs/migrating.md", "docs/upgrade.md", "docs/upgrading.md", "docs/source/whatsnew/index.rst", "doc/source/whatsnew/index.rst", "docs/source/release.rst", "doc/source/release.rst",
    "docs/source/release/index.rst", "doc/source/release/index.rst", "docs/releases/index.md", "doc/releases/index.md", "docs/migration/index.md", "docs/migration/index.rst", "docs/upgrading/index.md",
    "docs/upgrade/index.md", "docs/api/index.md", "docs/reference/index.md",
)
VERSIONED_NAMES = (
    "doc/source/release/{v}-notes.rst", "docs/source/release/{v}-notes.rst", "doc/source/release/{v}.rst", "docs/source/release/{v}.rst", "doc/release/{v}-notes.rst", "docs/release/{v}-notes.rst",
    "doc/releasenotes/{v}.rst", "docs/releasenotes/{v}.rst", "doc/release-notes/{v}.rst", "docs/release-notes/{v}.rst", "doc/release_notes/{v}.rst", "docs/release_notes/{v}.rst",
    "doc/releasenotes/{v}.md", "docs/releasenotes/{v}.md", "doc/release-notes/{v}.md", "docs/release-notes/{v}.md", "doc/release_notes/{v}.md", "docs/release_notes/{v}.md", "docs/releases/{v}.md",
    "release/{v}.md", "releases/{v}.md",
)
API_NAMES = (
    "docs/api/{s}.md", "docs/api/{s}.rst", "docs/reference/{s}.md", "docs/reference/{s}.rst", "docs/concepts/{s}.md", "docs/concepts/{s}s.md", "docs/usage/{s}.md",
    "doc/source/reference/generated/{a}.rst", "docs/source/reference/generated/{a}.rst",
)
#: Fixed value: symbols of a package whose pages are looked for.
MAX_SYMBOLS = 16
#: What a page says when there is none, and what shows that it is one of documentation all the same.
NOT_FOUND = ("page not found", "404 not found", "can't find the page", "could not find the page")
NOT_FOUND_DOCS = ("documentation", "contents index", "search terms", "current documentation")
DOCS_TOKENS = ("docs", "documentation", "readthedocs", "guide", "reference", "manual", "api", "learn", "wiki", "tutorial", "help")
MAX_CANDIDATES, MAX_TREE_DOCS = 18, 12


def candidate_paths(packages: DataFrame, symbols: DataFrame) -> DataFrame:
    """name, ord, path: fixed change logs, then those of each candidate version, then API pages of each symbol in
    order; each path once. packages: name, current, latest; symbols: name, symbol and, if there is one, ord."""
    def numbered(names: tuple[str, ...]) -> Column:
        return F.array(*map(F.lit, names))

    fixed = packages.select("name", F.lit(0).alias("stage"), F.lit(0).alias("major"), F.posexplode(numbered(CHANGELOG_NAMES)).alias("minor", "path"))
    by_version = packages.select("name", F.posexplode(candidate_versions(F.col("current"), F.col("latest"))).alias("major", "v"))
    versioned = by_version.select("name", "v", F.lit(1).alias("stage"), "major", F.posexplode(numbered(VERSIONED_NAMES)).alias("minor", "t")).select("name", "stage", "major", "minor", F.replace("t", F.lit("{v}"), F.col("v")).alias("path"))
    at = F.col("ord") if "ord" in symbols.columns else F.lit(0)
    distinct = symbols.groupBy("name", "symbol").agg(F.min(at).alias("_at"))
    placed = distinct.withColumn("major", F.row_number().over(Window.partitionBy("name").orderBy("_at", "symbol"))).where(F.col("major") <= MAX_SYMBOLS)
    api = F.replace(F.replace("symbol", F.lit("/"), F.lit(".")), F.lit("::"), F.lit("."))
    pages = placed.select("name", tx.slug(F.col("symbol")).alias("s"), api.alias("a"), F.lit(2).alias("stage"), "major", F.posexplode(numbered(API_NAMES)).alias("minor", "t"))
    pages = pages.select("name", "stage", "major", "minor", F.replace(F.replace("t", F.lit("{s}"), F.col("s")), F.lit("{a}"), F.col("a")).alias("path"))
    rows = fixed.unionByName(versioned).unionByName(pages).withColumn("ord", F.struct("stage", "major", "minor", "path"))
    return rel.first_rows(rows.select("name", "ord", "path"), ["name", "path"], ["ord"])


def present_paths(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates that the repository (name, path, content) has, with their content."""
    return candidates.join(files, ["name", "path"])


#: What a documentation path has to speak of, and the points of what it speaks of.
DOC_TOPICS = ("doc", "docs", "change", "release", "migration", "upgrade", "whatsnew", "api", "reference")
PATH_POINTS = {35: ("migration", "migrating", "upgrade", "upgrading"), 25: ("changelog", "changes", "history", "release", "whatsnew", "what"), 10: ("api", "reference", "concept", "usage")}
IN_DOCS, HAS_VERSION, NAMES_VERSION, NAMES_SLUG, NAMES_SYMBOL = 5, 20, 18, 22, 16


def path_score(path: Column, slugs: Column, versions: Column, compacts: Column | None = None) -> Column:
    """How likely a documentation file tells of a change; 0 for what isn't documentation.

    slugs, versions: arrays of what may be named. compacts: symbols in letters and digits alone, in the order of slugs; one
    counts where its slug does not.
    """
    low = F.lower(path)
    plain = F.regexp_replace(low, "[^a-z0-9]+", "")
    hits = lambda array: F.size(F.filter(array, lambda x: (x != "") & F.contains(low, F.lower(x))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    score = F.when(low.rlike("^docs?/"), IN_DOCS).otherwise(0) + F.when(F.size(versions_in_text(low)) > 0, HAS_VERSION).otherwise(0) + NAMES_VERSION * hits(versions) + NAMES_SLUG * hits(slugs)
    for points, words in PATH_POINTS.items():
        score = score + F.when(has(words), points).otherwise(0)
    if compacts is not None:
        other = F.zip_with(slugs, compacts, lambda s, c: (c != "") & F.contains(plain, c) & ~((s != "") & F.contains(low, F.lower(s))))
        score = score + NAMES_SYMBOL * F.size(F.filter(other, lambda x: x))
    return F.when(low.rlike(r"\.(md|rst|txt)$") & has(DOC_TOPICS), score).otherwise(0)


def tree_documents(files: DataFrame, fetched: DataFrame, slugs: Column, versions: Column, limit: int = MAX_TREE_DOCS) -> DataFrame:
    """path, path_score of the best documentation files of a repository that haven't been fetched."""
    scored = files.join(fetched, "path", "left_anti").withColumn("path_score", path_score(F.col("path"), slugs, versions))
    return scored.where("path_score > 0").orderBy(F.desc("path_score"), "path").limit(limit)


def linked_changelogs(index: DataFrame, low: str, high: str, limit: int = 8) -> DataFrame:
    """url, path of the version pages that an index page (url, content) links, newest first, inside the window."""
    lines = index.select("url", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where("trim(line) <> '' and not line rlike '^(\\\\.\\\\.|#|\\\\*|-)' and not line like '%://%'")
    paths = lines.withColumn("path", F.trim("line")).withColumn("v", F.get(versions_in_text(F.col("path")), F.lit(0))).where(version_in_window(F.coalesce("v", F.lit("")), F.lit(low), F.lit(high)))
    newest = F.transform(version_tuple(F.col("v")), lambda x: -x)
    ranked = paths.select("url", "path", newest.alias("k"), "pos")
    return ranked.groupBy("url").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "pos", "path"))), 1, limit).alias("best")).select("url", F.explode("best").alias("b")).select("url", "b.path")


def is_not_found(content: Column, url: Column) -> Column:
    """A page that says that there is none, at an address or among documentation."""
    said = tx.evidence_text(content)
    return said.rlike("|".join(NOT_FOUND)) & ((url != "") | said.rlike("|".join(NOT_FOUND_DOCS)))


def path_versions_relevant(path: Column, low: Column, high: Column) -> Column:
    """A path that names no version, or one that lies between two."""
    found = versions_in_text(path)
    return (F.size(found) == 0) | F.exists(found, lambda v: version_in_window(v, low, high))


def first_repository(links: DataFrame) -> DataFrame:
    """name, repository: of links (name, ord, url) the first that leads to GitHub, normalised."""
    rows = links.select("name", "ord", tx.repo_url(F.col("url")).alias("repository")).where(F.contains("repository", F.lit("github.com")))
    return rel.first_rows(rows, ["name"], ["ord"]).select("name", "repository")


def api_symbols(usages: DataFrame) -> DataFrame:
    """symbol, place: of usages (usage, ord), each with its last part and last two parts, the first spelling of a name."""
    own = F.trim(F.col("usage"))
    parts = F.filter(F.split(own, r"[.:/]+"), lambda p: p != "")
    every = F.concat(F.array(own), F.when(F.size(parts) >= 2, F.array(F.element_at(parts, -1), F.array_join(F.slice(parts, -2, 2), "."))).otherwise(F.array().cast("array<string>")))
    rows = usages.select("ord", F.posexplode(every).alias("n", "s")).select(F.struct("ord", "n").alias("place"), F.regexp_replace("s", r"^\.+|\.+$", "").alias("symbol")).where("symbol <> ''")
    return rel.first_rows(rows, [F.lower("symbol")], ["place"]).select("symbol", "place")


def is_docs_like(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^https?://([^/?#]+)", 1)
    return ~host.rlike(r"(^|\.)github\.com$") & F.regexp_extract(F.lower(url), r"^https?://([^?#]*)", 1).rlike("|".join(DOCS_TOKENS))


def docs_base(url: Column) -> Column:
    """Scheme and host, with the first path segment where it is a language or a version."""
    root = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    first = F.regexp_extract(url, r"^https?://[^/?#]+/((?:[a-z]{2}(?:-[a-z]{2})?|latest|stable|v?\d[\w.]*))(?:/|$)", 1)
    return F.when(first != "", F.concat(root, F.lit("/"), first)).otherwise(root)


def release_notes(releases: DataFrame, low: str) -> DataFrame:
    """name, content: releases (name, ord, tag, body; newest first) down to the first below low's major version, which
    is still taken."""
    floor = F.array(F.get(version_tuple(F.lit(low)), F.lit(0)), F.lit(0), F.lit(0))
    rows = releases.withColumn("_below", (F.size(version_tuple(F.col("tag"))) > 0) & (version_tuple(F.col("tag")) < floor))
    last = rows.groupBy("name").agg(F.min(F.when(F.col("_below"), F.col("ord"))).alias("_last"))
    kept = rows.join(last, "name").where("_last is null or ord <= _last")
    section = F.concat(F.lit("## Version "), F.col("tag"), F.lit("\n"), F.coalesce("body", F.lit("")))
    return kept.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", section.alias("s")))), lambda x: x["s"]), "\n\n").alias("content"))


def assemble(parts: list[DataFrame]) -> DataFrame:
    """ref_index, source, title, url, content: the parts in order, the first of equal (source, title, url) kept.

    parts: each with source, title, url, content, ord.
    """
    staged = [p.select(F.struct(F.lit(i).alias("stage"), F.col("ord")).alias("at"), "source", "title", "url", "content") for i, p in enumerate(parts)]
    first = rel.first_rows(reduce(DataFrame.unionByName, staged), ["source", "title", "url"], ["at"])
    packed = first.agg(F.sort_array(F.collect_list(F.struct("at", "source", "title", "url", "content"))).alias("r"))  # the references of one package
    return packed.select(F.posexplode("r").alias("ref_index", "r")).select("ref_index", "r.source", "r.title", "r.url", "r.content")


def registry_reference(spark: SparkSession, ecosystem: str, name: str) -> DataFrame:
    """The row that a registry's page of a package gives without being fetched."""
    return spark.range(1).select(F.lit(ecosystem).alias("source"), F.lit(name).alias("title"), tx.registry_url(F.lit(ecosystem), F.lit(name)).alias("url"), F.lit("").alias("content"), F.lit(0).alias("ord"))
