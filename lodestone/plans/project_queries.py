"""Manifests, lock files, code graphs, reviews and texts on the analytical tables, each query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import audit, code_graph, diff, evidence, references, retrieval, review, semantics
from lodestone.sources import lockfiles, manifests, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _versioned_parts(spark, sf_dir) -> DataFrame:
    """brand, name, version: each part as a package of its brand's project."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("pkg-"), "p_partkey").alias("name"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_size"), F.lit("0")).alias("version"), "p_partkey")


def _file(rows: DataFrame, name: str, line, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """path, name, content: one file of a brand, with a line for each of its parts in order of their keys."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), between)
    return rows.groupBy("brand").agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("content")).select(F.concat("brand", F.lit(f"/{name}")).alias("path"), F.lit(name).alias("name"), "content")


@query("""
    WITH p AS (SELECT p_brand AS brand, 'pkg-' || p_partkey AS name, (p_size % 4) || '.' || p_size || '.0' AS version, p_partkey AS k, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)
    SELECT brand || '/requirements.txt' AS file_path, 'pip' AS ecosystem, name, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE version END AS version, k % 3 <> 0 AS pinned FROM p
    UNION ALL SELECT brand || '/pyproject.toml', 'pip', name, version, true FROM p
    UNION ALL SELECT brand || '/package.json', 'npm', name, '^' || version, true FROM p
    UNION ALL SELECT brand || '/go.mod', 'go', 'example.com/' || name, 'v' || version, true FROM p
    UNION ALL SELECT brand || '/Cargo.toml', 'cargo', name, version, true FROM p
    UNION ALL SELECT brand || '/pom.xml', 'maven', 'org.x:' || name, version, true FROM p""")
def q_manifests(spark, sf_dir):
    """Six manifests for each brand, with a line for each part."""
    rows, name, version = _versioned_parts(spark, sf_dir), F.col("name"), F.col("version")
    required = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit("  # any"))).otherwise(F.concat(name, F.lit(" >= "), version, F.lit(", <9")))
    files = _file(rows, "requirements.txt", required, "# needs\n-r other.txt\n\n")
    files = files.unionByName(_file(rows, "pyproject.toml", F.concat(F.lit('"'), name, F.lit("=="), version, F.lit('"')), "[project]\ndependencies = [", "]\n", ", "))
    files = files.unionByName(_file(rows, "package.json", F.concat(F.lit('"'), name, F.lit('": "^'), version, F.lit('"')), '{"dependencies": {', "}}", ", "))
    files = files.unionByName(_file(rows, "go.mod", F.concat(F.lit("\texample.com/"), name, F.lit(" v"), version), "module m\n\nrequire (\n", "\n)\n"))
    files = files.unionByName(_file(rows, "Cargo.toml", F.concat(F.lit('"'), name, F.lit('" = { version = "'), version, F.lit('" }')), "[dependencies]\n"))
    files = files.unionByName(_file(rows, "pom.xml", F.concat(F.lit("<dependency><groupId>org.x</groupId><artifactId>"), name, F.lit("</artifactId><version>"), version, F.lit("</version></dependency>")), "<project><dependencies>", "</dependencies></project>", ""))
    return manifests.packages(files).drop("ord")


@query("""
    WITH p AS (SELECT 'pkg-' || p_partkey AS name, (p_size % 4) || '.' || p_size || '.0' AS version, p_partkey % 6 AS kind FROM part)
    SELECT lockfile, priority, name AS name_lower, version FROM (
        SELECT *, ['Pipfile.lock', 'poetry.lock', 'package-lock.json', 'yarn.lock', 'Cargo.lock', 'go.sum'][kind + 1] AS lockfile, kind::INT AS priority FROM p WHERE kind <> 5)
    UNION ALL SELECT 'go.sum', 5, unnest(['example.com/' || name, name]), 'v' || version FROM p WHERE kind = 5""")
def q_lockfiles(spark, sf_dir):
    """Each part in the lock files of one kind, a file for each brand."""
    rows, name, version = _versioned_parts(spark, sf_dir), F.col("name"), F.col("version")
    kind = lambda i: rows.where(F.col("p_partkey") % 6 == i)
    toml = F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\nversion = "'), version, F.lit('"\n'))
    files = _file(kind(0), "Pipfile.lock", F.concat(F.lit('"'), name, F.lit('": {"version": "=='), version, F.lit('"}')), '{"default": {', "}}", ", ")
    files = files.unionByName(_file(kind(1), "poetry.lock", toml)).unionByName(_file(kind(4), "Cargo.lock", toml))
    files = files.unionByName(_file(kind(2), "package-lock.json", F.concat(F.lit('"node_modules/'), name, F.lit('": {"version": "'), version, F.lit('"}')), '{"packages": {"": {"version": "1"}, ', "}}", ", "))
    files = files.unionByName(_file(kind(3), "yarn.lock", F.concat(F.lit('"'), name, F.lit("@^"), version, F.lit('":\n  version "'), version, F.lit('"\n')), "# yarn lockfile v1\n"))
    files = files.unionByName(_file(kind(5), "go.sum", F.concat(F.lit("example.com/"), name, F.lit(" v"), version, F.lit(" h1:x=\n"), F.lit("example.com/"), name, F.lit(" v"), version, F.lit("/go.mod h1:y="))))
    return lockfiles.lock_entries(files).drop("ord")


@query("""
    WITH e AS (SELECT p_partkey, '.' || ['py', 'tsx', 'RS', 'go', 'xyz', 'cs'][p_size % 6 + 1] AS ext FROM part)
    SELECT p_partkey, CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'tsx' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.cs' THEN 'c_sharp' END AS language,
           CASE lower(ext) WHEN '.py' THEN 'python' WHEN '.tsx' THEN 'tsx' WHEN '.rs' THEN 'rust' WHEN '.go' THEN 'go' WHEN '.cs' THEN 'csharp' ELSE '' END AS fence FROM e""")
def q_languages(spark, sf_dir):
    extension = F.get(F.array(*map(F.lit, (".py", ".tsx", ".RS", ".go", ".xyz", ".cs"))), (F.col("p_size") % 6).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", tree.language(extension).alias("language"), tx.fence_language(F.concat(F.lit("src/f"), extension)).alias("fence"))


@query("""
    SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_brand || '/' || p_type WHEN 1 THEN p_type WHEN 2 THEN NULL ELSE 'a/' || p_type END AS inside FROM part""")
def q_contained_paths(spark, sf_dir):
    brand, kind = F.col("p_brand"), F.col("p_type")
    given = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("./"), brand, F.lit("//"), kind)).when(F.col("p_size") % 4 == 1, F.concat(brand, F.lit("/../"), kind)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("../"), kind)).otherwise(F.concat(F.lit("a/b/../"), kind))
    return table(spark, sf_dir, "part").select("p_partkey", tree.under_root(F.lit("/srv/project"), given).alias("inside"))


@query("""
    WITH f AS (SELECT DISTINCT p_brand AS a, split_part(p_type, ' ', 1) AS b, p_container AS c FROM (SELECT *, p_size % 5 AS p_container FROM part))
    SELECT DISTINCT '' AS parent, a AS name, true AS is_folder FROM f UNION ALL SELECT DISTINCT a, b, true FROM f UNION ALL SELECT DISTINCT a || '/' || b, c || '.py', false FROM f""")
def q_folders(spark, sf_dir):
    path = F.concat("p_brand", F.lit("/"), F.split("p_type", " ")[0], F.lit("/"), F.col("p_size") % 5, F.lit(".py"))
    return tree.folders(table(spark, sf_dir, "part").select(path.alias("path")).distinct())


@query("""
    WITH r AS (SELECT p_partkey AS ord, p_brand AS name, (p_size % 6) || '.' || (p_partkey % 3) || '.0' AS tag, CASE WHEN p_size % 2 = 0 THEN p_type END AS body, p_size % 6 < 2 AS below FROM part),
    l AS (SELECT name, min(ord) FILTER (below) AS last FROM r GROUP BY name)
    SELECT name, string_agg('## Version ' || tag || chr(10) || coalesce(body, ''), chr(10) || chr(10) ORDER BY ord) AS content FROM r JOIN l USING (name) WHERE last IS NULL OR ord <= last GROUP BY name""")
def q_release_notes(spark, sf_dir):
    releases = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"), F.concat_ws(".", F.col("p_size") % 6, F.col("p_partkey") % 3, F.lit("0")).alias("tag"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("body"))
    return references.release_notes(releases, "2.4.0")


_CHANGELOG_SQL = """
    WITH s AS (SELECT user_id AS doc, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 5 AS a, event_id % 3 AS b, event_id % 2 AS c, event_type FROM events)"""


@query(_CHANGELOG_SQL + """,
    t AS (SELECT doc, n, a, b, c, a || '.' || b || '.' || c AS version, '## ' || a || '.' || b || '.' || c || chr(10) || event_type || ' ' || event_id AS content FROM s),
    k AS (SELECT *, b = 0 AND c = 0 AS major FROM t WHERE a * 100 + b * 10 + c BETWEEN 100 AND 310),
    o AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc ORDER BY NOT major, CASE WHEN major THEN a ELSE 0 END, -a, -b, -c, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
    SELECT doc, version, substr(content, 1, least(length(content), 60 - before)::BIGINT) AS content, least(length(content), 60 - before)::BIGINT AS used
    FROM o WHERE before < 60 AND (length(content) <= 60 - before OR 60 - before > 5)""")
def q_changelog_sections(spark, sf_dir):
    """A user's events as sections of a change log; documents without a section in the window are left out here."""
    event = F.col("event_id")
    version = F.concat_ws(".", event % 5, event % 3, event % 2)
    section = F.concat(F.lit("## "), version, F.lit("\n"), "event_type", F.lit(" "), event)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", section.alias("s")))), lambda x: x["s"])
    logs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc")).agg(F.array_join(ordered, "\n").alias("content"))
    return evidence.changelog_sections(logs, "1.0.0", "3.1.0", 60, 5).where("version is not null")


@query("""
    WITH n AS (SELECT p_partkey AS id, p_brand AS file, split_part(p_name, ' ', (1 + p_size % 2)::INT) AS name, split_part(p_name, ' ', (2 - p_size % 2)::INT) AS call FROM part),
    b AS (SELECT a.id AS source, a.call, min((CASE WHEN d.file = a.file THEN 0 ELSE 1 END, 'n' || d.id)) AS best FROM n a JOIN n d ON d.name = a.call GROUP BY a.id, a.call)
    SELECT 'n' || source AS source, best[2] AS target, call FROM b""")
def q_call_edges(spark, sf_dir):
    """Parts as functions of their brand's file, named by the first or second word of their name and calling the other."""
    word = lambda odd: F.get(F.split("p_name", " "), F.when(F.col("p_size") % 2 == odd, 1).otherwise(0))
    nodes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("n"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.lit(None).cast("string").alias("parent"), word(1).alias("name"), F.array().cast("array<string>").alias("defines"), F.array(word(0)).alias("calls")
    )
    return code_graph.call_edges(nodes)


@query("""
    WITH a AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, -n_chars AS n_chars FROM documents WHERE doc_id % 4 <> 0)
    SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS path, coalesce(b.n_chars, a.n_chars)::VARCHAR AS content FROM a FULL JOIN b USING (doc_id)""")
def q_overlay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("n"))
    return review.overlay(docs.where("doc_id % 3 <> 0").select("path", F.col("n").cast("string").alias("content")), docs.where("doc_id % 4 <> 0").select("path", (-F.col("n")).cast("string").alias("content")))


@query("""
    SELECT user_id::VARCHAR AS relative_path, sum(event_id % 7)::BIGINT AS additions, sum(event_id % 4)::BIGINT AS deletions, list('h' || event_id ORDER BY event_id % 100, event_type, 'h' || event_id) AS hunk_ids FROM events GROUP BY user_id""")
def q_merged_hunks(spark, sf_dir):
    event = F.col("event_id")
    return review.merged_hunks(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("relative_path"), (event % 7).alias("additions"), (event % 4).alias("deletions"), (event % 100).alias("old_start"), F.col("event_type").alias("session_id"), F.concat(F.lit("h"), event).alias("hunk_id")))


@query("""
    SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 3 = 0 THEN 'v' || p_size ELSE p_type END AS current_version FROM part""")
def q_reconcile(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    packages = part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("current_version"))
    accepted = part.where("p_size % 3 = 0").select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("v"), "p_size").alias("version"))
    return review.reconcile(packages, accepted).select("p_partkey", F.col("brand").alias("name"), "current_version")


@query(r"""
    WITH d AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Page Not Found. Search terms' WHEN 1 THEN ' 404 not found' ELSE '' END AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, regexp_matches(lower(t), 'page not found|404 not found|can''t find the page|could not find the page') AND regexp_matches(lower(t), 'documentation|contents index|search terms|current documentation') AS gone,
           regexp_matches(lower(t), 'removed|remove|deprecated|deprecation|renamed|replaced|replacement|instead|use |no longer|breaking|backwards incompatible|migration|upgrade|changed signature|signature|requires|must|now named|renamed to|has been renamed|has moved|moved to|migrate|review|construction|setup') AS migrates FROM d""")
def q_page_predicates(spark, sf_dir):
    said = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Page Not Found. Search terms").when(F.col("doc_id") % 3 == 1, " 404 not found").otherwise(""))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", said.alias("t"))
    return docs.select("doc_id", references.is_not_found(F.col("t"), F.lit("")).alias("gone"), tx.has_migration_language(F.col("t")).alias("migrates"))


@query(r"""
    WITH d AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_full_match(x, '[#=`~*\- ]+')) AS l FROM documents),
    s AS (SELECT doc_id, string_split_regex(regexp_replace(array_to_string(l, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM d)
    SELECT doc_id, substr(trim(array_to_string(list_filter(s[1:3], lambda x: x <> ''), ' ')), 1, 900) AS purpose FROM s""")
def q_purpose_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.purpose_sentences(F.coalesce("text", F.lit(""))).alias("purpose"))


@query(r"""
    WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'x = api.Pool(mode=1, size=n)' || chr(10) || 'x.take(2).give()' WHEN 1 THEN 'run(a, key=b)' ELSE 'self.db.close()' END AS code, 'lib.' || role || '.' || (conv_id % 4) AS api FROM conversations),
    e AS (
        SELECT DISTINCT api, 'calls ' || m AS what FROM (SELECT api, unnest(regexp_extract_all(code, '\.(\w+)\s*\(', 1)) AS m FROM c)
        UNION SELECT DISTINCT api, 'passes ' || w FROM (SELECT api, unnest(regexp_extract_all(code, '[(,]\s*(\w+)\s*=', 1)) AS w FROM c))
    SELECT api, string_agg(what, '; ' ORDER BY what) AS purpose FROM e GROUP BY api""")
def q_called_contexts(spark, sf_dir):
    code = F.when(F.col("turn") % 3 == 0, "x = api.Pool(mode=1, size=n)\nx.take(2).give()").when(F.col("turn") % 3 == 1, "run(a, key=b)").otherwise("self.db.close()")
    return semantics.called_contexts(table(spark, sf_dir, "conversations").select(F.concat_ws(".", F.lit("lib"), "role", F.col("conv_id") % 4).alias("api"), code.alias("code_snippet")))


@query(r"""
    WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    r AS (SELECT doc_id, l, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n FROM l)
    SELECT doc_id, sha256(array_to_string(CASE WHEN n >= 2 AND doc_id % 2 = 0 THEN list_concat(list_concat(['one'], ['two', 'three']), l[3:]) WHEN doc_id % 2 = 0 THEN list_concat(['one'], l[2:]) ELSE list_concat(['one'], l[2:]) END, chr(10))) AS content FROM r""")
def q_spliced_lines(spark, sf_dir):
    """The first line replaced in all documents, the second by two in every other one, and lines that no text has."""
    part = lambda a, b, t: F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(t).alias("replacement"))
    ranges = F.when(F.col("doc_id") % 2 == 0, F.array(part(2, 2, "two\nthree\n"), part(1, 1, "one"), part(1 << 30, 1 << 30, "x"))).otherwise(F.array(part(1, 1, "one")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(diff.splice(F.coalesce("text", F.lit("")), ranges), 256).alias("content"))


@query("""
    WITH r AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'OK' ELSE 'LOW' END AS s FROM orders)
    SELECT floor(sum(CASE s """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in audit.WEIGHTS.items()) + """ END) / 100000)::INT AS health_score, 100000 AS total_packages, """ + ", ".join(f"count(*) FILTER (s = '{s}')::INT AS {s.lower()}" for s in audit.WEIGHTS) + """ FROM r""")
def q_health_of_scan(spark, sf_dir):
    """Orders as reported packages of a scan that counted 100,000."""
    priority = F.col("o_orderpriority")
    severity = F.when(priority == "1-URGENT", "CRITICAL").when(priority == "2-HIGH", "HIGH").when(priority == "3-MEDIUM", "MEDIUM").when(priority == "5-LOW", "OK").otherwise("LOW")
    return audit.health(table(spark, sf_dir, "orders").select(severity.alias("severity")), 100_000)


@query(r"""
    WITH b AS (SELECT conv_id, turn, 'event: x' || chr(10) || 'data: {"event": "progress", "phase": "' || role || '", "total_files": ' || turn || '}' || chr(10) || chr(10) || 'data: {broken' || chr(10) || 'data: {"phase": "done", "success": true}' AS v FROM conversations)
    SELECT phase, total_files, count(*) AS n FROM (SELECT role AS phase, turn::INT AS total_files FROM conversations UNION ALL SELECT 'done', NULL FROM conversations) GROUP BY ALL""")
def q_sse_events(spark, sf_dir):
    from lodestone.streaming import progress

    block = F.concat(F.lit('event: x\ndata: {"event": "progress", "phase": "'), "role", F.lit('", "total_files": '), "turn", F.lit('}\n\ndata: {broken\ndata: {"phase": "done", "success": true}'))
    return progress.sse_events(table(spark, sf_dir, "conversations").select(block.alias("value"))).groupBy("phase", "total_files").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    SELECT conv_id, turn, rtrim(CASE turn % 3 WHEN 0 THEN 'import a' || chr(10) || 'from b import c' || chr(10) || chr(10) || 'x = 1' WHEN 1 THEN 'x = 1' ELSE 'use std::io;' || chr(10) || 'fn main() {}' END) AS context
    FROM conversations""")
def q_import_context(spark, sf_dir):
    code = F.when(F.col("turn") % 3 == 0, "import a\nfrom b import c\n\nx = 1\ny = 2").when(F.col("turn") % 3 == 1, "x = 1").otherwise("use std::io;\nfn main() {}\nfn b() {}")
    context = retrieval.import_context(code)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, F.lit("x = 1")).otherwise(context).alias("context"))


@query("""
    WITH c AS (SELECT p_partkey, p_size, p_brand, p_type FROM part),
    s AS (SELECT DISTINCT p_brand AS name, lower(replace(p_type, ' ', '_')) AS symbol FROM c),
    x AS (SELECT name, symbol, row_number() OVER (PARTITION BY name ORDER BY symbol) AS n FROM s),
    t AS (SELECT name, n, unnest(range(0, 9)) AS j, unnest(['docs/api/{s}.md', 'docs/api/{s}.rst', 'docs/reference/{s}.md', 'docs/reference/{s}.rst', 'docs/concepts/{s}.md', 'docs/concepts/{s}s.md', 'docs/usage/{s}.md',
          'doc/source/reference/generated/{s}.rst', 'docs/source/reference/generated/{s}.rst']) AS path, symbol FROM x WHERE n <= 16)
    SELECT name, n::INT AS symbol_place, j::INT AS template, replace(path, '{s}', symbol) AS path FROM t""")
def q_symbol_paths(spark, sf_dir):
    """The pages of the first symbols of each brand, of all candidate paths."""
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_brand").alias("name"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("symbol")).distinct()
    found = references.candidate_paths(part.select(F.col("p_brand").alias("name"), F.lit("1.2.0").alias("current"), F.lit("2.0.0").alias("latest")).distinct(), symbols)
    return found.where("ord.stage = 2").select("name", F.col("ord.major").alias("symbol_place"), F.col("ord.minor").alias("template"), "path")


@query("""
    WITH p AS (SELECT p_brand AS path, count(*) AS n FROM part GROUP BY p_brand)
    SELECT path, additions, deletions FROM (SELECT p_brand AS path, sum(p_size % 3)::INT AS additions, sum(p_size % 2)::INT AS deletions FROM part GROUP BY p_brand)""")
def q_change_counts(spark, sf_dir):
    """A brand's parts as hunks, with lines added and removed by size."""
    line = lambda kind: F.struct(F.lit(kind).alias("type"))
    size = F.col("p_size")
    changes = F.concat(F.array_repeat(line(diff.NEW), (size % 3).cast("int")), F.array_repeat(line(diff.GONE), (size % 2).cast("int")), F.array(line("context")))
    hunks = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.collect_list(F.struct(changes.alias("changes"))).alias("hunks"))
    return diff.change_counts(hunks, "path")


@query("""
    WITH n AS (SELECT 'n' || p_partkey AS id, p_brand AS file, split_part(p_name, ' ', 1) AS name FROM part)
    SELECT id AS target, file AS def_file, name AS sym FROM n""")
def q_definitions(spark, sf_dir):
    name = F.split("p_name", " ")[0]
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.lit(None).cast("string").alias("parent"), name.alias("name"), F.array(name).alias("defines"))
    return code_graph.definitions(nodes)


@query("""
    WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT source AS file, 'h' || doc_id AS hunk_id, old_line::BIGINT AS old_line, (old_line + (n - 1) * 2)::BIGINT AS new_line FROM (SELECT *, unnest(range((n - 1) * 10 + CASE WHEN n = 1 THEN 1 ELSE 5 END, n * 10)) AS old_line FROM d)""")
def q_gap_lines(spark, sf_dir):
    """A source's documents as hunks of five lines, ten apart, each two lines longer than before."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hunks = table(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.concat(F.lit("h"), "doc_id").alias("hunk_id"), (n * 10).cast("long").alias("old_start"), F.lit(5).cast("long").alias("old_lines"), F.lit(7).cast("long").alias("new_lines"))
    return review.gap_lines(hunks, "file")


@query(r"""
    WITH m AS (SELECT conv_id, turn, chr(10) || 'src/a' || (turn % 3) || '.ts:' || (turn + 1) || ':2 bad' || chr(10) || '  File "b.py", line ' || (conv_id % 50 + 1) || chr(10) || 'c.cs(' || (turn * 3 + 1) || ',4): error' AS t FROM conversations)
    SELECT conv_id, turn, 'b.py' AS file, (conv_id % 50 + 1)::INT AS line, 0 AS pattern FROM m
    UNION ALL SELECT conv_id, turn, 'src/a' || (turn % 3) || '.ts', (turn + 1)::INT, 2 FROM m
    UNION ALL SELECT conv_id, turn, 'c.cs', (turn * 3 + 1)::INT, 3 FROM m
    UNION ALL SELECT conv_id, turn, 'src/a' || (turn % 3) || '.ts', (turn + 1)::INT, 4 FROM m""")
def q_error_places(spark, sf_dir):
    """Places of errors that tools write in four ways, in an output for each turn."""
    output = F.concat(
        F.lit("\nsrc/a"), F.col("turn") % 3, F.lit(".ts:"), F.col("turn") + 1, F.lit(':2 bad\n  File "b.py", line '), F.col("conv_id") % 50 + 1, F.lit("\nc.cs("), F.col("turn") * 3 + 1, F.lit(",4): error")
    )
    rows = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), output.alias("text"))
    return diff.error_locations(rows, "k", "text").select("k.conv_id", "k.turn", "file", "line", "pattern")


@query("""
    WITH e AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS created FROM events GROUP BY user_id), n AS (SELECT max(created) AS now FROM e)
    SELECT user_id, created, now - created <= 36000 AS alive FROM e, n""")
def q_live_sessions(spark, sf_dir):
    """Users whose last event is at most ten hours before the newest one."""
    from lodestone.streaming import progress

    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")).alias("created"))
    now = seen.agg(F.max("created").alias("now"))  # one row
    return seen.join(F.broadcast(now), F.lit(True)).select("user_id", "created", progress.live(F.col("created"), F.col("now"), 36_000).alias("alive"))


@query("""
    WITH b AS (SELECT source AS file, n_chars % 900 AS s, n_chars % 900 + doc_id % 7 AS e, 'k' || doc_id % 2 AS kind, 'f' || doc_id % 3 AS name FROM documents),
    n AS (SELECT *, max(e) OVER (PARTITION BY file ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM n)
    SELECT file, min(s) AS start_line, max(e) AS end_line, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'merged_block' END AS context_type, CASE WHEN min(name) = max(name) THEN min(name) END AS name FROM g GROUP BY file, island""")
def q_merged_blocks(spark, sf_dir):
    """Documents as blocks of their source, by length."""
    start = F.col("n_chars") % 900
    return diff.merged_blocks(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), start.alias("start_line"), (start + F.col("doc_id") % 7).alias("end_line"), F.concat(F.lit("k"), F.col("doc_id") % 2).alias("context_type"), F.concat(F.lit("f"), F.col("doc_id") % 3).alias("name")))


@query("""
    SELECT p_partkey AS id, unnest(list_distinct([split_part(p_name, ' ', 1), p_brand || '.' || split_part(p_name, ' ', 1)])) AS sym FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT p_partkey, split_part(p_name, ' ', 2) FROM part WHERE p_size % 2 = 1""")
def q_exported(spark, sf_dir):
    """Parts of even size as methods of their brand, the others as modules that define the second word of their name."""
    words, even = F.split("p_name", " "), F.col("p_size") % 2 == 0
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent"), words[0].alias("name"), F.when(even, "method").otherwise("module_level").alias("context_type"), F.array(words[1]).alias("defines"))
    return code_graph.exported(nodes).withColumnRenamed("node", "id")


@query("""
    WITH p AS (SELECT name, priority, enabled FROM (SELECT p_partkey::VARCHAR AS name, p_size AS priority, p_size % 2 = 0 AS enabled FROM part))
    SELECT name, (row_number() OVER (ORDER BY CASE name WHEN '12' THEN 0 WHEN '4' THEN 1 ELSE 2 END, priority, name))::INT AS priority FROM p WHERE enabled""")
def q_provider_order(spark, sf_dir):
    """Parts of even size as providers, two of them wanted first where they are enabled."""
    providers = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("priority"), (F.col("p_size") % 2 == 0).alias("enabled"))
    return review.provider_order(providers, ["12", "4"])


@query("""
    WITH l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, (event_id % 4) || '.' || (event_id % 5) AS v FROM events WHERE event_id % 3 <> 0),
    r AS (SELECT user_id, 'changes/' || v || '.rst' AS path, row_number() OVER (PARTITION BY user_id ORDER BY -split_part(v, '.', 1)::INT, -split_part(v, '.', 2)::INT, pos) AS n FROM l WHERE split_part(v, '.', 1)::INT * 10 + split_part(v, '.', 2)::INT BETWEEN 11 AND 23)
    SELECT user_id::VARCHAR AS url, path FROM r WHERE n <= 8""")
def q_linked_changelogs(spark, sf_dir):
    """A user's events as links of an index page, every third as a heading that is none."""
    event = F.col("event_id")
    line = F.when(event % 3 == 0, F.concat(F.lit("# "), event)).otherwise(F.concat(F.lit("  changes/"), event % 4, F.lit("."), event % 5, F.lit(".rst")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("url")).agg(F.array_join(ordered, "\n").alias("content"))
    return references.linked_changelogs(pages, "1.0.0", "2.3.0")


@query("""
    WITH r AS (SELECT p_brand AS key, p_size % 9 + 1 AS s, p_size % 9 + 1 + p_partkey % 2 AS e FROM part),
    b AS (SELECT DISTINCT p_brand AS key, p_size % 9 + 1 AS s, p_size % 9 + 1 AS e FROM part WHERE p_partkey % 3 <> 0),
    c AS (SELECT key, s, e, count(*) AS n FROM r GROUP BY ALL),
    m AS (SELECT c.key, CASE WHEN b.s IS NULL THEN 'lines ' || c.s || '-' || c.e || ' are no block' WHEN n > 1 THEN 'lines ' || c.s || '-' || c.e || ' come ' || n || ' times' END AS error FROM c LEFT JOIN b USING (key, s, e))
    SELECT key AS brand, coalesce(list(error ORDER BY error) FILTER (error IS NOT NULL), []) AS errors FROM m GROUP BY key""")
def q_matched_blocks(spark, sf_dir):
    """A brand's parts as replaced line ranges, against blocks of two thirds of them."""
    from lodestone.operators import patches

    size = (F.col("p_size") % 9 + 1).cast("int")
    part = table(spark, sf_dir, "part")
    one = F.struct(size.alias("start_line"), (size + F.col("p_partkey") % 2).cast("int").alias("end_line"), F.lit("x").alias("replacement"))
    replaced = part.groupBy(F.col("p_brand").alias("brand")).agg(F.collect_list(one).alias("replacements"))
    blocks = part.where("p_partkey % 3 <> 0").select(F.col("p_brand").alias("brand"), size.alias("start_line"), size.alias("end_line"))
    return patches.matched_blocks(replaced, blocks, "brand")


@query(r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n[ \t]*\n'), lambda x: trim(x) <> '') AS ps FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS n FROM d),
    r AS (
        SELECT doc_id, n, 0 AS chunk, para AS content FROM t WHERE n = 1
        UNION ALL SELECT q.doc_id, q.n, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN content || chr(10) || chr(10) || para ELSE para END
        FROM (SELECT t.doc_id, t.n, r.chunk, r.content, t.para, length(r.content) + length(t.para) + 2 <= 700 AS fits FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1) q)
    SELECT doc_id, chunk AS chunk_index, arg_max(content, n) AS content FROM r GROUP BY doc_id, chunk""")
def q_evidence_chunks(spark, sf_dir):
    """Lines as paragraphs of all documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"))
    return evidence.chunks(docs, 700)


@query("""
    SELECT count(*) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7)) AS edges, count(DISTINCT p_brand) AS files FROM part""")
def q_graph_stats(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    later = part.select((F.col("p_partkey") - 7).alias("source"), F.col("p_partkey").alias("target"))
    edges = later.join(part.select(F.col("p_partkey").alias("source")), "source", "left_semi")
    return code_graph.graph_stats(part.select("p_partkey", F.col("p_brand").alias("file")), edges)


@query("""
    SELECT p_partkey, contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1') AS shown FROM part""")
def q_graph_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", code_graph.matches_query("Brand#1", "p_name", "p_brand", "p_type").alias("shown"))


@query("""
    WITH c AS (SELECT doc_id AS ref_index, 0 AS chunk_index, CASE doc_id % 4 WHEN 0 THEN 'Release notes' WHEN 1 THEN 'Migration guide' ELSE 'Blog' END AS title,
                      substr(coalesce(text, ''), 1, 40) || CASE doc_id % 3 WHEN 0 THEN ' breaking' WHEN 1 THEN ' removed, please migrate' ELSE '' END AS content FROM documents),
    s AS (SELECT *, CASE WHEN contains(lower(content), 'breaking') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'removed|renamed') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'migrat|deprecat') THEN 15 ELSE 0 END AS score
          FROM c WHERE title <> 'Blog')
    SELECT ref_index, score FROM s WHERE score > 0 ORDER BY score DESC, ref_index, chunk_index LIMIT 4""")
def q_fallback_chunks(spark, sf_dir):
    title = F.when(F.col("doc_id") % 4 == 0, "Release notes").when(F.col("doc_id") % 4 == 1, "Migration guide").otherwise("Blog")
    note = F.when(F.col("doc_id") % 3 == 0, " breaking").when(F.col("doc_id") % 3 == 1, " removed, please migrate").otherwise("")
    content = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 40), note)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_index"), F.lit(0).alias("chunk_index"), F.lit("web").alias("source"), title.alias("title"), F.lit("").alias("url"), content.alias("content"))
    return evidence.fallback_chunks(docs).select("ref_index", F.col("score").cast("int").alias("score"))


@query(r"""
    WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'docs/' || p_partkey || '.md' WHEN 1 THEN 'docs/migration/v' || (p_partkey % 10) || '.0.rst' WHEN 2 THEN 'src/a' || p_partkey || '.py' ELSE 'changelog-' || p_partkey || '.txt' END AS path FROM part),
    f AS (SELECT DISTINCT path FROM p WHERE p_partkey % 5 = 0),
    s AS (
        SELECT DISTINCT path, CASE WHEN regexp_matches(path, '^docs?/') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(path, '[0-9]+\.[0-9]+') THEN 20 ELSE 0 END + CASE WHEN contains(path, '2.0') THEN 18 ELSE 0 END
               + CASE WHEN contains(path, '77') THEN 22 ELSE 0 END + CASE WHEN contains(path, 'migration') THEN 35 ELSE 0 END + CASE WHEN contains(path, 'changelog') THEN 25 ELSE 0 END AS path_score
        FROM p WHERE path NOT IN (SELECT path FROM f) AND regexp_matches(path, '\.(md|rst|txt)$'))
    SELECT path, path_score FROM s WHERE path_score > 0 ORDER BY path_score DESC, path LIMIT 12""")
def q_tree_documents(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size") % 4
    path = F.when(size == 0, F.concat(F.lit("docs/"), key, F.lit(".md"))).when(size == 1, F.concat(F.lit("docs/migration/v"), key % 10, F.lit(".0.rst"))).when(size == 2, F.concat(F.lit("src/a"), key, F.lit(".py"))).otherwise(F.concat(F.lit("changelog-"), key, F.lit(".txt")))
    files = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    fetched = files.where("p_partkey % 5 = 0").select("path").distinct()
    return references.tree_documents(files.select("path").distinct(), fetched, F.array(F.lit("77")), F.array(F.lit("2.0")))
