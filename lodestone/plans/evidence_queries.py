"""Evidence for changes on the analytical tables, each query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evidence, focus, obligations, semantics

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


def _words(text, least=4):
    """Lower-case words of some letters, as SQL has them too."""
    return F.regexp_extract_all(tx.lower_in_place(text), F.lit(f"([a-z]{{{least},}})"), F.lit(1))


#: Documents whose ids are divisible by 3 speak of a removal, those by 5 of a use.
_NOTED = "CASE WHEN doc_id % 3 = 0 THEN ' It was removed.' WHEN doc_id % 5 = 0 THEN ' Please use another.' ELSE '' END"
_SAID_SQL = "trim(regexp_replace(replace(regexp_replace(lower({0}), ':[a-z_:]+:`~?([^`]+)`', '\\1', 'g'), '`', ''), '\\s+', ' ', 'g'))"


@query(rf"""
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS w FROM benchmark),
    c AS (
        SELECT item_id AS change_id, CASE WHEN item_id % 2 = 0 THEN 'removed' ELSE 'renamed' END AS type, 'acme.' || w[1] || '.' || w[2] AS old_api, 'acme.' || w[3] AS new_api,
               'acme.' || w[1] || '.' || w[2] AS o1, w[1] || '.' || w[2] AS o2, CASE WHEN length(w[2]) >= 8 THEN w[2] END AS o3, w[3] AS n1 FROM i WHERE len(w) >= 3),
    r AS (SELECT doc_id, source, text || {_NOTED} AS content FROM documents WHERE text IS NOT NULL),
    s AS MATERIALIZED (SELECT doc_id, content, {_SAID_SQL.format("concat_ws(chr(10), source, source, content)")} AS said FROM r),
    m AS MATERIALIZED (SELECT *, regexp_matches(said, 'removed|remove|no longer|deprecated|deprecation|expired') AS gone FROM s WHERE regexp_matches(said, '{"|".join(tx.MIGRATION_WORDS)}')),
    n AS (
        SELECT change_id, type, unnest([o1, o2, o3]) AS name, true AS direct FROM c WHERE o3 IS NULL OR o3 NOT IN ({", ".join(f"'{x}'" for x in tx.AMBIGUOUS_LEAVES)})
        UNION ALL SELECT change_id, type, unnest([o1, o2]), true FROM c WHERE o3 IN ({", ".join(f"'{x}'" for x in tx.AMBIGUOUS_LEAVES)})
        UNION ALL SELECT change_id, type, unnest(['acme.' || n1, n1]), false FROM c),
    k AS (SELECT DISTINCT doc_id, gone, unnest(string_split_regex(said, '[^\p{{L}}\p{{N}}_.]+')) AS name FROM m),
    p AS (SELECT change_id, type, doc_id, gone, bool_or(direct) AS direct FROM n JOIN k USING (name) GROUP BY ALL)
    SELECT change_id, type AS change_type, min(doc_id) AS source_index, arg_min(direct, doc_id) AS direct
    FROM p WHERE CASE WHEN direct THEN type <> 'removed' OR gone ELSE doc_id % 2 = 0 END GROUP BY change_id, type""")
def q_supporting_references(spark, sf_dir):
    """Items as changes from their first words to their third, documents as references; every second one is close in meaning."""
    words = _words(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 3)
    name = lambda *i: F.concat_ws(".", F.lit("acme"), *(F.get("w", F.lit(x)) for x in i))
    changes = rows.select(F.col("item_id").alias("change_id"), F.when(F.col("item_id") % 2 == 0, "removed").otherwise("renamed").alias("type"), name(0, 1).alias("old_api"), name(2).alias("new_api"))
    noted = F.when(F.col("doc_id") % 3 == 0, " It was removed.").when(F.col("doc_id") % 5 == 0, " Please use another.").otherwise("")
    docs = table(spark, sf_dir, "documents").where("text is not null")
    references = docs.select(
        F.col("doc_id").alias("ref_index"), F.col("source"), F.col("source").alias("title"), F.col("source").alias("url"), F.concat("text", noted).alias("content"), (1 - F.col("doc_id") % 2).alias("semantic_score"),
        F.array().cast("array<string>").alias("matched_terms"), F.lit("").alias("evidence_confidence"),
    )
    found = evidence.supporting_references(changes, references)
    # A quote around an old name says that the support is direct.
    leaf = lambda c: F.element_at(F.split(c, r"\."), -1)
    old = F.transform(tx.evidence_variants(F.col("api")), tx.evidence_text)
    said = tx.evidence_text(F.col("quote"))
    direct = F.exists(old, lambda v: F.rlike(said, F.concat(F.lit(r"(?U)(?<![\w.])\Q"), v, F.lit(r"\E(?![\w.])"))))
    return found.select("change_id", "change_type", "source_index", direct.alias("direct"), leaf("replacement").alias("_r")).drop("_r")


@query(rf"""
    WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{{6,}}') AS w FROM benchmark),
    p AS MATERIALIZED (SELECT DISTINCT w[1] AS owner, w[2] AS method FROM i WHERE len(w) >= 2),
    s AS MATERIALIZED (SELECT doc_id, {_SAID_SQL.format("coalesce(text, '')")} AS said FROM documents),
    o AS MATERIALIZED (
        SELECT doc_id, said, owner, method, contains(said, owner || '.' || method) AS exact FROM s JOIN p ON contains(said, owner) AND contains(said, method)),
    a AS (SELECT *, string_split(said, owner) AS x, string_split(said, method) AS y FROM o WHERE NOT exact),
    q AS (
        SELECT doc_id, said, owner, method, list_transform(range(1, len(x)), lambda k: list_sum(list_transform(x[1:k], lambda v: length(v)))::BIGINT + (k - 1) * length(owner)) AS u,
               list_transform(range(1, len(y)), lambda k: list_sum(list_transform(y[1:k], lambda v: length(v)))::BIGINT + (k - 1) * length(method)) AS v FROM a),
    n AS (
        SELECT doc_id, owner, method, bool_or(regexp_matches(substr(said, greatest(0, b - {semantics.SIGNAL_CHARS}) + 1, (b + length(method) + {semantics.SIGNAL_CHARS} - greatest(0, b - {semantics.SIGNAL_CHARS}))::BIGINT), '{"|".join(semantics.SIGNALS)}')) AS marked,
               bool_or(len(list_filter(u, lambda g: abs(g - b) <= {semantics.NEAR_CHARS})) > 0) AS near
        FROM (SELECT *, unnest(v) AS b FROM q) GROUP BY ALL),
    t AS (
        SELECT doc_id, CASE WHEN marked THEN 70 ELSE 35 END AS points FROM n WHERE near
        UNION ALL SELECT doc_id, 90 + 70 * regexp_matches(said, '\buse\b[^.\n]{{0,180}}\bnot\b[^.\n]{{0,80}}' || regexp_escape(owner || '.' || method))::INT
                       + 70 * regexp_matches(said, '\bnot\b[^.\n]{{0,80}}' || regexp_escape(owner || '.' || method) || '[^.\n]{{0,180}}\buse\b')::INT
                       + 35 * regexp_matches(said, regexp_escape(owner || '.' || method) || '[^.\n]{{0,160}}\b(?:removed|deprecated|legacy|no longer)\b')::INT
                       + 35 * regexp_matches(said, '\b(?:removed|deprecated|legacy|no longer)\b[^.\n]{{0,160}}' || regexp_escape(owner || '.' || method))::INT
        FROM o WHERE exact)
    SELECT doc_id, coalesce(sum(points), 0)::BIGINT AS method_score FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def q_method_scores(spark, sf_dir):
    """The first two long words of every item as owner and method, in all documents."""
    rows = table(spark, sf_dir, "benchmark").select(_words(F.col("text"), 6).alias("w")).where(F.size("w") >= 2)
    profiles = rows.select(F.get("w", F.lit(0)).alias("owner"), F.get("w", F.lit(1)).alias("method"))
    return semantics.method_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), profiles, "doc_id", "text")


@query(rf"""
    WITH s AS MATERIALIZED (SELECT doc_id, {_SAID_SQL.format("coalesce(replace(replace(text, ' the ', ' option '), ' of ', ' required '), '')")} AS said FROM documents),
    k AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')[1:2]) AS keyword FROM benchmark),
    h AS MATERIALIZED (
        SELECT doc_id, keyword, regexp_replace(regexp_replace(said, '(^|[^\p{{L}}\p{{N}}_])' || keyword || '(?:\b)', '\1' || chr(1) || repeat(chr(2), (length(keyword) - 1)::BIGINT), 'g'),
               '(^|[^\p{{L}}\p{{N}}_])' || keyword || '(?:\b)', '\1' || chr(1) || repeat(chr(2), (length(keyword) - 1)::BIGINT), 'g') AS said FROM s JOIN k ON contains(said, keyword)),
    x AS (SELECT *, string_split(said, chr(1)) AS parts FROM h),
    o AS (SELECT doc_id, said, keyword, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda v: length(v)))::BIGINT + i - 1)) AS pos FROM x),
    w AS (SELECT doc_id, keyword, chr(1) || repeat(chr(2), (length(keyword) - 1)::BIGINT) AS mark, substr(said, greatest(0, pos - 250) + 1, pos - greatest(0, pos - 250) + 400) AS part FROM o)
    SELECT DISTINCT doc_id, keyword FROM w
    WHERE regexp_matches(part, '{"|".join(obligations.KEYWORD_MARKS)}')
      AND (regexp_matches(part, '\x01\x02*\s*=') OR regexp_matches(part, '\x01\x02*[^.\n\x02]{{0,80}}\b(?:{"|".join(obligations.NOUNS)})\b') OR regexp_matches(part, '\b(?:{"|".join(obligations.NOUNS)})\b[^.\n]{{0,100}}\x01'))""")
def q_keyword_migrations(spark, sf_dir):
    """The first two words of every item as keywords, in all documents; two frequent words stand for words of evidence."""
    said = F.replace(F.replace("text", F.lit(" the "), F.lit(" option ")), F.lit(" of "), F.lit(" required "))
    keywords = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(_words(F.col("text")), 1, 2)).alias("keyword")).distinct()
    return obligations.keyword_migrations(table(spark, sf_dir, "documents").select("doc_id", said.alias("text")), keywords)


@query(r"""
    WITH t AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' run("x")' WHEN 1 THEN ' db.run(y)' ELSE '' END AS source,
                      coalesce(text, '') || CASE conv_id % 4 WHEN 0 THEN ' Passing a string is deprecated.' WHEN 1 THEN ' with db.begin() as tx' WHEN 2 THEN ' a raw string' ELSE '' END AS evidence FROM conversations),
    s AS (SELECT conv_id, turn, source, lower(regexp_replace(replace(evidence, '`', ''), '\s+', ' ', 'g')) AS e, lower(regexp_replace(evidence, '\s+', ' ', 'g')) AS f FROM t)
    SELECT conv_id, turn, 'string_argument' AS obligation FROM s WHERE regexp_matches(source, '\w+\s*\(\s*[''"]')
      AND regexp_matches(e, 'passing a string|string to|raw string|textual sql|textual statement|string statements require|sql string') AND regexp_matches(e, 'deprecated|removed|will be removed|no longer|requires|must|use ')
    UNION ALL SELECT conv_id, turn, 'context_manager' FROM s WHERE regexp_matches(source, '\.\w+\s*\(')
      AND (regexp_matches(f, '\bwith\s+[^.\n]{0,120}\bas\b') OR contains(f, 'context manager') OR contains(f, 'connect() as') OR contains(f, 'begin() as') OR contains(f, 'explicit transaction'))""")
def q_migration_obligations(spark, sf_dir):
    said = F.coalesce("text", F.lit(""))
    code = F.when(F.col("turn") % 3 == 0, ' run("x")').when(F.col("turn") % 3 == 1, " db.run(y)").otherwise("")
    note = F.when(F.col("conv_id") % 4 == 0, " Passing a string is deprecated.").when(F.col("conv_id") % 4 == 1, " with db.begin() as tx").when(F.col("conv_id") % 4 == 2, " a raw string").otherwise("")
    targets = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(said, code).alias("source"), F.concat(said, note).alias("evidence"))
    return obligations.migration_obligations(targets).select("conv_id", "turn", "obligation")


@query(r"""
    WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{8,}')[1:3]) AS term FROM benchmark),
    d AS MATERIALIZED (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id, text, term, string_split(lower(text), term) AS parts FROM d JOIN k ON contains(lower(text), term)),
    o AS (SELECT doc_id, text, term, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda v: length(v)))::BIGINT + (i - 1) * length(term))) AS pos FROM x),
    h AS MATERIALIZED (
        SELECT *, greatest(0, pos - 900) AS s, least(length(text), pos + length(term) + 900) AS e FROM o
        WHERE regexp_matches(substr(text, pos + length(term) + 1, 1), '^([^\p{L}\p{N}_.]|$)') AND (pos = 0 OR regexp_matches(substr(text, pos, 1), '[^\p{L}\p{N}_.]'))),
    b AS (SELECT *, instr(reverse(substr(text, 1, s)), chr(10) || chr(10)) AS r, instr(substr(text, e + 1), chr(10) || chr(10)) AS f FROM h),
    w AS (
        SELECT doc_id, term, CASE WHEN r > 0 AND pos - (s - r - 1) <= 1800 THEN s - r + 1 ELSE s END AS a, CASE WHEN f > 0 AND e + f - 1 - pos <= 1800 THEN e + f - 1 ELSE e END AS z, text FROM b),
    g AS (SELECT doc_id, a, z, any_value(text) AS text, arg_min(term, (-length(term), term)) AS term FROM w GROUP BY doc_id, a, z)
    SELECT doc_id, a::INT AS "start", z::INT AS "end", substr(trim(substr(text, a + 1, z - a), ' ' || chr(9) || chr(10) || chr(13)), 1, 2100) AS content,
           (length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')) + 1)::INT AS line_start,
           (length(substr(text, 1, z)) - length(replace(substr(text, 1, z), chr(10), '')) + 1)::INT AS line_end, term FROM g""")
def q_api_windows(spark, sf_dir):
    """Windows around the first long words of every item in all documents (these have no code blocks)."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.slice(_words(F.col("text"), 8), 1, 3)).alias("term")).distinct()
    return focus.api_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, "doc_id", "text")


@query(r"""
    WITH k AS (SELECT DISTINCT item_id % 5 AS package, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')[1:2]) AS term FROM benchmark),
    d AS MATERIALIZED (SELECT doc_id % 5 AS package, doc_id, trim(text || ' It was removed.', ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents WHERE text IS NOT NULL),
    x AS (SELECT package, doc_id, text, term, string_split(lower(text), term) AS parts FROM d JOIN k USING (package) WHERE contains(lower(text), term)),
    o AS MATERIALIZED (SELECT package, doc_id, text, term, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda v: length(v)))::BIGINT + (i - 1) * length(term))) AS pos FROM x),
    s AS (SELECT package, doc_id, text, greatest(0, pos - 900) AS b, least(length(text), pos + length(term) + 900) AS e FROM o),
    n AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before + 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS place FROM n),
    i AS (SELECT package, doc_id, any_value(text) AS text, place, min(b) AS b, max(e) AS e FROM g WHERE place <= 4 GROUP BY ALL),
    c AS (
        SELECT package, doc_id, string_agg(CASE WHEN b > 0 THEN '... ' ELSE '' END || trim(substr(text, b + 1, e - b), ' ' || chr(9) || chr(10) || chr(13)) || CASE WHEN e < length(text) THEN ' ...' ELSE '' END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS content
        FROM i GROUP BY ALL)
    SELECT package, doc_id AS ref_index, content, m.terms[1:8] AS matched_terms FROM c JOIN (SELECT doc_id, list(DISTINCT term ORDER BY -length(term), term) AS terms FROM o GROUP BY doc_id) m USING (doc_id)""")
def q_term_stretches(spark, sf_dir):
    """Documents and items dealt to five packages: stretches around the first words of a package's items in its documents."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("package"), F.explode(F.slice(_words(F.col("text"), 6), 1, 2)).alias("term"), F.lit(True).alias("strong")).distinct()
    docs = table(spark, sf_dir, "documents").where("text is not null")
    references = docs.select((F.col("doc_id") % 5).alias("package"), F.col("doc_id").alias("ref_index"), F.concat("text", F.lit(" It was removed.")).alias("content"))
    return focus.term_stretches(references, items).select("package", "ref_index", "content", "matched_terms")
