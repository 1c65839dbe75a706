"""The operators around the use of an API on the analytical tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import diff, retrieval

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


@query("""
    WITH p AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN 'Scikit_Learn' ELSE replace(p_name, ' ', '-') END AS package FROM part),
    r AS (SELECT package, package AS root FROM p UNION SELECT package, replace(package, '-', '_') FROM p UNION SELECT package, replace(package, '_', '-') FROM p
          UNION SELECT package, 'sklearn' FROM p WHERE package = 'Scikit_Learn')
    SELECT package, root FROM r WHERE root <> ''""")
def q_import_roots(spark, sf_dir):
    package = F.when(F.col("p_size") % 5 == 0, "Scikit_Learn").otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return retrieval.import_roots(table(spark, sf_dir, "part").select(package.alias("package")).distinct())


@query("""
    WITH m AS (SELECT conv_id AS file, turn AS line, min(role) AS api FROM conversations WHERE role = 'assistant' AND turn > 0 GROUP BY ALL ORDER BY file, line, api LIMIT 40)
    SELECT m.file, m.line, m.api, string_agg(coalesce(c.text, ''), chr(10) ORDER BY c.turn, c.text NULLS FIRST) AS context
    FROM m JOIN conversations c ON c.conv_id = m.file AND c.turn BETWEEN m.line - 2 AND m.line + 2 GROUP BY ALL""")
def q_usage_contexts(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), "text", F.col("role").alias("api"))
    return retrieval.usage_contexts(lines, lines.where("api = 'assistant'"))


@query(r"""
    WITH t AS (SELECT doc_id, text, unnest(['the', 'and']) AS term FROM documents),
    s AS (SELECT doc_id, text, term, string_split(lower(text), term) AS parts FROM t),
    c AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS i, parts FROM s),
    o AS (SELECT doc_id, text, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * 3 AS a FROM c),
    w AS (SELECT doc_id, text, greatest(0, a - 30) AS b, least(length(text), a + 33) AS e FROM o),
    n AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR b > before + 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS place FROM n)
    SELECT doc_id, place::BIGINT AS place, min(b)::BIGINT AS "start", max(e)::BIGINT AS "end", trim(substr(any_value(text), min(b)::BIGINT + 1, (max(e) - min(b))::BIGINT)) AS snippet
    FROM g WHERE place <= 4 GROUP BY doc_id, place""")
def q_term_windows(spark, sf_dir):
    return retrieval.term_windows(table(spark, sf_dir, "documents"), ["the", "and"], around=30, gap=10)


@query("""
    WITH u AS (SELECT DISTINCT p_brand AS package, CASE WHEN p_size % 10 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_brand || '.' || p_type ELSE p_brand || '.' || p_type || '.' || split_part(p_name, ' ', 1) END AS usage FROM part),
    k AS (SELECT package, usage FROM u WHERE usage <> package),
    s AS (SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.package = a.package AND starts_with(b.usage, a.usage || '.'))),
    r AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY len(string_split(usage, '.')) DESC, length(usage) DESC, usage) AS place FROM s)
    SELECT package, usage, place::INTEGER AS place FROM r WHERE place <= 80""")
def q_review_targets(spark, sf_dir):
    brand, kind = F.col("p_brand"), F.concat_ws(".", "p_brand", "p_type")
    usage = F.when(F.col("p_size") % 10 == 0, brand).when(F.col("p_size") % 3 == 0, kind).otherwise(F.concat_ws(".", kind, F.split("p_name", " ")[0]))
    return retrieval.review_targets(table(spark, sf_dir, "part").select(brand.alias("package"), usage.alias("usage")))


@query(r"""
    WITH d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '\bwith\s+[^.\n]{0,120}\bas\b') OR contains(t, 'context manager') OR contains(t, 'connect() as') OR contains(t, 'begin() as') OR contains(t, 'explicit transaction') AS found FROM d""")
def q_context_manager(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.mentions_context_manager(F.col("text")).alias("found"))


@query("""
    WITH e AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS r, event_type = 'click' AS c FROM events),
    n AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY r, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM e WHERE r IS NOT NULL)
    SELECT user_id, event_id, ['ast_scan', 'scout', 'patch', 'done'][r] AS phase, (row_number() OVER (PARTITION BY user_id ORDER BY r, event_id))::INTEGER AS place FROM n WHERE NOT c OR nth <= 6""")
def q_ordered_phases(spark, sf_dir):
    phase = F.create_map(*(F.lit(x) for x in ("view", "ast_scan", "click", "scout", "purchase", "patch", "error", "done")))[F.col("event_type")]
    events = table(spark, sf_dir, "events").select("user_id", "event_id", phase.alias("phase"), (F.col("event_type") == "click").alias("change"))
    return retrieval.ordered_phases(events, "user_id", "phase", "event_id", F.col("change")).select("user_id", "event_id", "phase", "place")


@query("""
    WITH l AS (SELECT max(floor(epoch(ts))::BIGINT) AS now FROM events),
    a AS (SELECT user_id AS key, max(event_id) AS response FROM (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, max(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id) AS m FROM events, l WHERE event_type <> 'error' AND now - floor(epoch(ts))::BIGINT <= 864000)
          WHERE t = m GROUP BY user_id)
    SELECT DISTINCT user_id AS key, response FROM events LEFT JOIN a ON key = user_id""")
def q_cached_responses(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("created", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    now = events.agg(F.max("created")).first()[0] or 0
    newest = events.where("event_type <> 'error'").groupBy(F.col("user_id").alias("key"), "created").agg(F.max("event_id").alias("response"))
    return retrieval.cached_responses(events.select(F.col("user_id").alias("key")).distinct(), newest, F.lit(now), 864_000)


@query("""
    WITH m AS (SELECT p_brand AS file, CASE WHEN p_size % 4 = 0 THEN 'impact_review' ELSE 'migration_review' END AS type, p_type AS api FROM part WHERE p_size > 3),
    c AS (SELECT DISTINCT p_type AS api FROM part WHERE p_size = 7 AND p_brand = 'Brand#11')
    SELECT file, NOT bool_or(api IN (SELECT api FROM c)) AS skip FROM m GROUP BY file""")
def q_speculative_reviews(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "impact_review").otherwise("migration_review")
    matches = part.where("p_size > 3").select(F.col("p_brand").alias("file"), kind.alias("type"), F.col("p_type").alias("api"))
    changes = part.where("p_size = 7 and p_brand = 'Brand#11'").select(F.lit("removed").alias("type"), F.col("p_type").alias("api"))
    return retrieval.speculative_reviews(matches, changes, part.where("false").select(F.col("p_type").alias("api")))


@query()
def q_line_edits(spark, sf_dir):
    """The edit script from each turn to the turn with the next number; they meet by key, without a window."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    edits = turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.explode(diff.edit_script("text", "next")).alias("e"))
    return edits.select("conv_id", "turn", "e.type", "e.text", "e.old_line", "e.new_line")
