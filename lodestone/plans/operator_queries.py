"""The library's own operators on the analytical tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import versions as vs
from lodestone.operators import audit, previews, references
from lodestone.operators import relational as rel

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


_ECOSYSTEM = ("pip", "npm", "go", "cargo", "maven", "pypi")


def ecosystem_of(number):
    return F.get(F.array(*map(F.lit, _ECOSYSTEM)), (number % 6).cast("int"))


_ECOSYSTEM_SQL = f"{list(_ECOSYSTEM)}[p_size % 6 + 1]"


@query(f"""
    WITH p AS (SELECT p_partkey, p_name, {_ECOSYSTEM_SQL} AS e FROM part)
    SELECT p_partkey, e AS ecosystem,
           CASE e WHEN 'pip' THEN 'PYPI' WHEN 'npm' THEN 'NPM' WHEN 'go' THEN 'GO' WHEN 'cargo' THEN 'CARGO' WHEN 'maven' THEN 'MAVEN' ELSE '' END AS deps_dev,
           CASE e WHEN 'pip' THEN 'PyPI' WHEN 'npm' THEN 'npm' WHEN 'go' THEN 'Go' WHEN 'cargo' THEN 'crates.io' WHEN 'maven' THEN 'Maven' ELSE '' END AS osv,
           CASE e WHEN 'npm' THEN 'https://www.npmjs.com/package/' || p_name WHEN 'pypi' THEN 'https://pypi.org/project/' || p_name WHEN 'cargo' THEN 'https://crates.io/crates/' || p_name
                  WHEN 'go' THEN 'https://pkg.go.dev/' || p_name WHEN 'maven' THEN 'https://search.maven.org/artifact/' || replace(p_name, ':', '/') ELSE 'https://deps.dev/' || e || '/' || p_name END AS url FROM p""")
def q_ecosystem_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", ecosystem_of(F.col("p_size")).alias("ecosystem"))
    e = F.col("ecosystem")
    return rows.select("p_partkey", "ecosystem", tx.deps_dev_system(e).alias("deps_dev"), tx.osv_ecosystem(e).alias("osv"), tx.registry_url(e, F.col("p_name")).alias("url"))


@query(r"""
    WITH l AS (
        SELECT p_brand, p_partkey, lower(replace(p_brand, '#', '-')) AS o FROM part),
    u AS (
        SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'https://example.org/' || p_partkey WHEN 1 THEN 'https://github.com/' || o || '/r' || p_partkey
                       WHEN 2 THEN 'https://github.com/sponsors/' || o ELSE 'https://github.com/' || o || '/r' || p_partkey END AS repository FROM l)
    SELECT p_brand AS name, arg_min('https://github.com/' || o || '/r' || p_partkey, p_partkey) AS repository, arg_min(o, p_partkey) AS owner, arg_min('r' || p_partkey, p_partkey) AS repo
    FROM u WHERE p_partkey % 4 IN (1, 3) GROUP BY p_brand""")
def q_repo_lookup(spark, sf_dir):
    owner, key = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://example.org/"), key)).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("git+https://github.com/"), owner, F.lit("/r"), key, F.lit(".git")))
    url = url.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("https://github.com/sponsors/"), owner)).otherwise(F.concat(F.lit("git@github.com:"), owner, F.lit("/r"), key))
    found = references.first_repository(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ord"), url.alias("url")))
    return found.withColumn("o", tx.owner_repo(F.col("repository"))).select("name", "repository", "o.owner", "o.repo")


@query("""
    WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS name, (p_size % 3) || '.0' AS a, CASE WHEN p_size % 7 = 0 THEN NULL ELSE (p_partkey % 3) || '.0' END AS b FROM part)
    SELECT p_partkey FROM p WHERE trim(name) <> '' AND b IS NOT NULL AND a <> b""")
def q_update_candidates(spark, sf_dir):
    text = lambda c: F.concat(c.cast("string"), F.lit(".0"))
    name = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name"))
    latest = F.when(F.col("p_size") % 7 != 0, text(F.col("p_partkey") % 3))
    return table(spark, sf_dir, "part").where(previews.is_update_candidate(name, text(F.col("p_size") % 3), latest)).select("p_partkey")


@query("""
    SELECT count(*) AS files_scanned, count(n) AS files_affected, coalesce(sum(n), 0)::BIGINT AS total_matches
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY doc_id) USING (doc_id)""")
def q_scan_totals(spark, sf_dir):
    return previews.scan_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("""
    WITH f AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS a, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS d FROM lineitem)
    SELECT l_orderkey, count(*) FILTER (a + d > 0) AS total_files_changed, sum(a)::BIGINT AS total_additions, sum(d)::BIGINT AS total_deletions FROM f GROUP BY l_orderkey""")
def q_preview_totals(spark, sf_dir):
    count = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")).otherwise(0)
    return previews.preview_totals(table(spark, sf_dir, "lineitem").select("l_orderkey", count("R").alias("additions"), count("A").alias("deletions")), "l_orderkey")


@query("""
    SELECT l_orderkey, string_agg(l_linenumber || '-' || l_partkey || '=' || CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'accept' END, ',' ORDER BY l_linenumber || '-' || l_partkey || '=' || CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'accept' END) AS hunks
    FROM lineitem GROUP BY l_orderkey""")
def q_decision_payload(spark, sf_dir):
    decision = F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "accepted").otherwise("pending")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("-", "l_linenumber", "l_partkey").alias("hunk_id"), decision.alias("decision"))
    return previews.decision_payload(rows, ["l_orderkey"]).select("l_orderkey", F.array_join("hunks", ",").alias("hunks"))


@query("""
    WITH d AS (SELECT p_partkey, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey),
    r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, p_partkey) - 1 AS place FROM d)
    SELECT p_partkey, degree, place, round(cos(place * (pi() * (3 - sqrt(5)))) * (42 + sqrt(place) * 95), 3) AS x, round(sin(place * (pi() * (3 - sqrt(5)))) * (42 + sqrt(place) * 95), 3) AS y FROM r""")
def q_graph_layout(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("degree"))
    placed = previews.layout(rel.lookup_left(parts, counts, ["p_partkey"], "degree", F.lit(0).cast("bigint")), "p_partkey")
    return placed.select("p_partkey", "degree", F.col("place").cast("bigint").alias("place"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 40")
def q_context_limit(spark, sf_dir):
    return previews.first_in_order(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 40)


@query("""
    WITH u AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || ' Mod' || p_size || ' ' || p_type ELSE lower(p_brand || ' Mod' || p_size || ' ' || p_type) END AS t FROM part),
    w AS (SELECT p_partkey, replace(t, ' ', '.') AS usage, string_split(t, ' ') AS p FROM u),
    s AS (
        SELECT p_partkey, 0 AS n, usage AS symbol FROM w
        UNION ALL SELECT p_partkey, 1, p[-1] FROM w WHERE len(p) > 1
        UNION ALL SELECT p_partkey, 2, p[-2] || '.' || p[-1] FROM w WHERE len(p) > 1)
    SELECT arg_min(symbol, (p_partkey, n)) AS symbol FROM s GROUP BY lower(symbol)""")
def q_api_symbols(spark, sf_dir):
    said = F.replace(F.concat("p_brand", F.lit(" Mod"), F.col("p_size").cast("string"), F.lit(" "), "p_type"), F.lit(" "), F.lit("."))
    return references.api_symbols(table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, said).otherwise(F.lower(said)).alias("usage"), F.col("p_partkey").alias("ord"))).select("symbol")


@query("SELECT lang, source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY lang, source, n_chars")
def q_evidence_dedupe(spark, sf_dir):
    return previews.distinct_evidence(table(spark, sf_dir, "documents").select("lang", "source", "n_chars", "doc_id"), ["lang", "source", "n_chars"], ["doc_id"])


@query("""
    SELECT l_suppkey, l_linenumber, l_returnflag, arg_min(l_orderkey, (l_orderkey, l_partkey)) AS l_orderkey FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag""")
def q_location_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag", "l_orderkey", "l_partkey")
    return rel.first_rows(rows, ["l_suppkey", "l_linenumber", "l_returnflag"], ["l_orderkey", "l_partkey"]).drop("l_partkey")


@query("""
    WITH p AS (SELECT p_partkey, p_size, p_size // 10 AS a, p_partkey % 4 AS b FROM part)
    SELECT p_partkey FROM p WHERE p_size % 3 = 0 OR (a * 100 + b > 200 AND a * 100 + b <= 402)""")
def q_path_versions(spark, sf_dir):
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_partkey") % 4).cast("string"))
    path = F.when(F.col("p_size") % 3 == 0, "docs/changes.md").otherwise(F.concat(F.lit("docs/v"), version, F.lit("/index.md")))
    return table(spark, sf_dir, "part").where(references.path_versions_relevant(path, F.lit("2.3"), F.lit("4.2"))).select("p_partkey")


@query(r"""
    SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' ' || p_name), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS token,
           lower(replace(p_type, ' ', '.')) AS api, trim(regexp_replace(replace(lower(p_type || '  `' || p_name || '`'), '`', ''), '\s+', ' ', 'g')) AS evidence,
           CASE WHEN length(p_type || ' ' || p_name) > 20 THEN rtrim(substr(p_type || ' ' || p_name, 1, 20)) || '...' ELSE p_type || ' ' || p_name END AS sentence
    FROM part""")
def q_text_normalise(spark, sf_dir):
    both = F.concat("p_type", F.lit(" "), "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        tx.slug(both).alias("slug"),
        tx.package_token(F.col("p_brand")).alias("token"),
        tx.api_name(F.concat(F.lit("."), F.replace("p_type", F.lit(" "), F.lit("::")), F.lit("()"))).alias("api"),
        tx.evidence_text(F.concat("p_type", F.lit("  `"), "p_name", F.lit("`"))).alias("evidence"),
        tx.compact_sentence(F.concat("p_type", F.lit("   "), "p_name"), 20).alias("sentence"),
    )


@query(r"""
    WITH p AS (SELECT p_partkey, p_size || '.' || (p_partkey % 10) || '.1' AS v FROM part)
    SELECT p_partkey, v AS cleaned, v || ',<9' AS stripped, 'name (' || v || ') and ' || v || '-x' AS pinned, 2::BIGINT AS n_found FROM p""")
def q_version_text(spark, sf_dir):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("1"))
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("v"))
    return rows.select(
        "p_partkey",
        vs.clean_version(F.concat(F.lit(" >=v"), "v", F.lit(",<9"))).alias("cleaned"),
        vs.strip_range(F.concat(F.lit("^~ V"), "v", F.lit(",<9"))).alias("stripped"),
        vs.repin(F.concat(F.lit("name (0.0.7) and "), "v", F.lit("-x")), F.lit("NAME"), F.lit("0.0.7"), F.col("v")).alias("pinned"),
        F.size(vs.versions_in_text(F.concat(F.lit("from v"), "v", F.lit(" to "), "v"))).cast("bigint").alias("n_found"),
    )


@query(r"""
    WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(lower(url), '^https?://([^?#]*)', 1) AS plain, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS first FROM pages)
    SELECT page_id, NOT regexp_matches(lower(host), '(^|\.)github\.com$') AND regexp_matches(plain, 'docs|documentation|readthedocs|guide|reference|manual|api|learn|wiki|tutorial|help') AS docs_like,
           regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_matches(url, '^https?://[^/?#]+/[^/?#]+(/|$)') AND regexp_matches(first, '^([a-z]{2}(-[a-z]{2})?|latest|stable|v?[0-9][0-9A-Za-z_.]*)$') THEN '/' || first ELSE '' END AS base FROM p""")
def q_docs_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", references.is_docs_like(F.col("url")).alias("docs_like"), references.docs_base(F.col("url")).alias("base"))


@query(r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
    r AS (SELECT *, regexp_matches(line, '^\s*$') AS blank, coalesce(sum(length(line) + 1) OVER w, 0) AS pl FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, coalesce(sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM r)
    SELECT doc_id, (min(pos) + 1)::INTEGER AS line_start, (max(pos) + 1)::INTEGER AS line_end, min(pl)::BIGINT AS start, max(pl + length(line))::BIGINT AS "end" FROM g WHERE NOT blank GROUP BY doc_id, run""")
def q_paragraphs(spark, sf_dir):
    return previews.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
    WITH m AS (SELECT l_orderkey, l_linenumber * 7 AS line, l_linenumber AS s, l_linenumber + l_partkey % 200 AS e, CASE WHEN l_returnflag = 'R' THEN 'module_level' ELSE 'function' END AS kind, l_suppkey * 100 AS chars, l_partkey FROM lineitem),
    r AS (SELECT *, CASE WHEN kind = 'module_level' AND e - s + 1 > 90 THEN 45 WHEN e - s + 1 > 140 OR chars > 14000 THEN 45 END AS radius FROM m)
    SELECT l_orderkey, l_partkey, line, CASE WHEN radius IS NULL THEN s ELSE greatest(1, line - radius) END AS start_line, CASE WHEN radius IS NULL THEN e ELSE least(150, line + radius) END AS end_line,
           CASE WHEN radius IS NULL THEN kind ELSE kind || '_slice' END AS context_type FROM r""")
def q_bounded_blocks(spark, sf_dir):
    n, big = F.col("l_linenumber").cast("bigint"), F.col("l_partkey").cast("bigint")
    kind = F.when(F.col("l_returnflag") == "R", "module_level").otherwise("function")
    block = previews.bounded_block(n * 7, n, n + big % 200, kind, F.col("l_suppkey") * 100, F.lit(150))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (n * 7).alias("line"), block.alias("b")).select("l_orderkey", "l_partkey", "line", "b.*")


@query("""
    SELECT l_orderkey, string_agg(DISTINCT l_suppkey - 2, ',' ORDER BY l_suppkey - 2) AS lines FROM lineitem WHERE l_suppkey > 2 GROUP BY l_orderkey""")
def q_changed_lines(spark, sf_dir):
    rows = previews.changed_lines(table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") - 2).alias("line")), "l_orderkey")
    return rows.select("l_orderkey", F.array_join("lines", ",").alias("lines"))


@query("""
    WITH a AS (
        SELECT l_orderkey, l_suppkey AS file, l_linenumber::BIGINT AS line, 0 AS s, l_linenumber * 100000000 + l_partkey AS o FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey, l_suppkey, 1, 1, l_linenumber * 100000000 + l_partkey FROM lineitem WHERE l_returnflag <> 'R'),
    f AS (SELECT l_orderkey, file, arg_min(line, (s, o)) AS line, min((s, o)) AS pl FROM a GROUP BY l_orderkey, file)
    SELECT l_orderkey, file, line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY pl) AS n FROM f) WHERE n <= 4""")
def q_repair_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")).alias("ord"), "l_returnflag")
    return previews.repair_candidates(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), "l_orderkey", 4)


@query("""
    WITH m AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS start_line, 'impact_review' AS type, l_returnflag AS id FROM lineitem WHERE l_returnflag = 'R'),
    a AS (SELECT DISTINCT l_suppkey AS file, l_linenumber AS start_line, 'impact_review' AS type, l_returnflag AS id FROM lineitem WHERE l_partkey % 5 <= 2)
    SELECT *, false AS added FROM m UNION ALL SELECT *, true FROM a WHERE (file, start_line, type, id) NOT IN (SELECT (file, start_line, type, id) FROM m)""")
def q_expanded_matches(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_returnflag").alias("id"), (F.col("l_partkey") % 5).alias("depth"))
    return previews.expanded_matches(line.where("id = 'R'").withColumn("type", F.lit("impact_review")), line.withColumnRenamed("id", "node"))


@query("""
    WITH p AS (SELECT p_partkey, 'kit.mod' || p_size || '.' || lower(p_type) AS api, ['kit', 'mod' || p_size, lower(p_type)] AS w FROM part)
    SELECT p_partkey, w[-2] || '.' || w[-1] AS last_two, api || '|' || w[-2] || '.' || w[-1] || '|' || w[-1] || '()|' || w[-1] AS variants,
           ends_with(api, '.' || w[-1]) AS called, length(w[-1]) <= 5 AS weak, w[-1] = 'tin' AS same FROM p WHERE len(w) = 3""")
def q_api_variants(spark, sf_dir):
    api = F.concat(F.lit("kit::mod"), F.col("p_size").cast("string"), F.lit("::"), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", api.alias("api")).withColumn("leaf", F.element_at(tx.name_parts(F.col("api")), -1)).where(F.size(tx.name_parts(F.col("api"))) == 3)
    return rows.select(
        "p_partkey",
        tx.last_parts(F.col("api"), 2).alias("last_two"),
        F.array_join(tx.replacement_variants(F.col("api")), "|").alias("variants"),
        tx.call_matches(F.replace("api", F.lit("::"), F.lit(".")), F.col("leaf")).alias("called"),
        tx.weak_term(F.col("leaf")).alias("weak"),
        tx.target_matches_callable(F.lit("my_tin"), F.concat(F.lit("a.make_"), F.col("leaf"))).alias("same"),
    )


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), 'the') AS a FROM documents)
    SELECT doc_id, CASE WHEN a = 0 THEN '' ELSE trim(substr(t, greatest(1, a - 20), (a + 2 + 20) - greatest(1, a - 20) + 1), ' ') END AS focus FROM d""")
def q_focus_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.focus_text(F.coalesce("text", F.lit("")), F.array(F.lit("THE")), 20).alias("focus"))


@query(f"""
    WITH p AS (SELECT p_partkey, p_brand, {_ECOSYSTEM_SQL} AS ecosystem, p_name AS name, (p_size // 20) || '.' || (p_size % 20) || '.0' AS version, p_size % 9 <> 0 AS pinned FROM part),
    l AS (SELECT ecosystem, max(version) AS latest FROM p GROUP BY ecosystem),
    a AS (SELECT DISTINCT ecosystem, name, version FROM p WHERE p_partkey % 17 = 0),
    g AS (
        SELECT p.p_partkey, p.p_brand, p.pinned, l.latest,
               CASE WHEN NOT pinned THEN 'UNPINNED' WHEN a.name IS NOT NULL THEN 'CRITICAL'
                    WHEN string_split(p.version, '.')[1]::INT < string_split(latest, '.')[1]::INT THEN 'HIGH'
                    WHEN string_split(p.version, '.')[1]::INT = string_split(latest, '.')[1]::INT AND string_split(p.version, '.')[2]::INT < string_split(latest, '.')[2]::INT THEN 'MEDIUM' ELSE 'OK' END AS severity,
               CASE WHEN pinned THEN p.version ELSE 'unknown' END AS current_version
        FROM p JOIN l USING (ecosystem) LEFT JOIN a ON a.ecosystem = p.ecosystem AND a.name = p.name AND a.version = p.version)
    SELECT p_brand AS file_path, severity, current_version, latest AS latest_version, count(*) AS n FROM g GROUP BY ALL""")
def q_audit_report(spark, sf_dir):
    version = F.concat_ws(".", F.floor(F.col("p_size") / 20).cast("string"), (F.col("p_size") % 20).cast("string"), F.lit("0"))
    packages = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("file_path"), ecosystem_of(F.col("p_size")).alias("ecosystem"), F.col("p_name").alias("name"), version.alias("version"), (F.col("p_size") % 9 != 0).alias("pinned"), F.lit("manifest").alias("resolved_from"), "p_partkey"
    )
    advisories = packages.where("p_partkey % 17 = 0").select("ecosystem", "name", "version", F.array(F.struct(F.lit("id").alias("id"), F.lit("").alias("summary"))).alias("cves"))
    newest = packages.groupBy("ecosystem").agg(F.max("version").alias("latest_version"))
    latest = packages.select(F.col("ecosystem").alias("system"), "name").distinct().join(newest.withColumnRenamed("ecosystem", "system"), "system")
    report = audit.report(packages, advisories, latest)
    return report.groupBy("file_path", "severity", "current_version", "latest_version").agg(F.count(F.lit(1)).alias("n"))
