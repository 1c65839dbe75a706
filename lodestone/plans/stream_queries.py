"""Streams on the analytical tables, each query with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.storage import shared_folder, stored
from lodestone.streaming import progress, sandbox

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
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT event_id) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def q_stream_closed_windows(spark, sf_dir):
    """Days that the watermark has closed; the last one stays open."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    counts = progress.run_available(progress.closed_windows(stream, "ts", "event_type", "1 day", "1 hour", "event_id"), "append", shared_folder(spark))
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""
    WITH e AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
    v AS (SELECT user_id, min(ord) AS since FROM e WHERE t = 'click' GROUP BY user_id),
    p AS (SELECT user_id, since, count(*) FILTER (t = 'view' AND ord < since) AS files FROM e JOIN v USING (user_id) GROUP BY ALL),
    r AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS n FROM e JOIN p USING (user_id) WHERE ord > since AND t IN ('purchase', 'error') AND files > 0),
    a AS (SELECT user_id, max(t) FILTER (n = 1) AS one, max(t) FILTER (n = 2) AS two FROM r GROUP BY user_id),
    o AS (
        SELECT user_id, CASE WHEN files = 0 THEN ['done'] ELSE list_concat(['phase', 'verify_fail', 'phase', 'repair_attempt'],
               CASE WHEN one IS NULL THEN [] WHEN one = 'purchase' THEN ['repair_done', 'done'] WHEN two IS NULL THEN ['repair_attempt']
                    WHEN two = 'purchase' THEN ['repair_attempt', 'repair_done', 'done'] ELSE ['repair_attempt', 'repair_fail', 'done'] END) END AS es
        FROM p LEFT JOIN a USING (user_id))
    SELECT user_id::VARCHAR AS session, (generate_subscripts(es, 1) - 1)::INT AS place, unnest(es) AS event FROM o""")
def q_sandbox_phases(spark, sf_dir):
    """A user's events as a session: views change files, the first click is a check that fails, purchases are repairs that help and errors ones that do not."""
    at, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    step = F.when(kind == "view", "patch").when(kind == "click", "verify").when(kind.isin("purchase", "error"), "repair").otherwise("none")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session"), nth.alias("ord"), step.alias("kind"), F.col("event_id").cast("string").alias("file"),
        F.when(kind == "click", "failed").when(kind == "purchase", "success").otherwise("partial").alias("status"), F.when(kind.isin("click", "error"), "pytest").alias("checks"), at.alias("at"),
    )
    rows = stored(events, "session-events")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        phases = sandbox.sandbox_phases(spark.readStream.schema(rows.schema).parquet(folder), attempts=2, ttl=10 * 365 * 86_400, late="365 days")
        return progress.run_available(phases, "append", shared_folder(spark)).select("session", "place", "event")
    finally:
        spark.conf.set(provider, before)
