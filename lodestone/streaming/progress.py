"""Progress events and review sessions as streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Fixed value: seconds that a review session lives after its last change.
SESSION_TTL = 1800
EVENT_SCHEMA = (
    "event string, phase string, message string, file string, package string, old_api string, new_api string, change_type string, description string, success boolean, usage_count int, "
    "file_count int, breaking_changes_count int, total_files int, additions int, deletions int, attempt int, files_repaired array<string>"
)


def sse_events(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Progress events from server-sent blocks: parts between blank lines, their `data: ` lines, bad JSON left out.

    Works on batch tables and on streams alike.
    """
    lines = blocks.select(F.explode(F.split(text, r"\n")).alias("line")).where(F.col("line").startswith("data: "))
    return lines.select(F.from_json(F.substring("line", 7, 1 << 30), EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).where("e.event is not null or e.phase is not null").select("e.*")


def progress_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts of each kind in tumbling windows; rows later than `late` are dropped. at: any timestamp."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def user_sessions(events: DataFrame, at: str, user: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user that a gap ends."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(user, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def expire_sessions(changes: DataFrame, key: str, at: str, ttl: int = SESSION_TTL) -> DataFrame:
    """A stream of sessions that have ended: key, created, last_change, changes.

    Each change puts the session's end off; it ends when event time has passed it by ttl seconds. State is three
    numbers for each live session.
    """

    def step(ids: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [ids[0]], "created": [pd.Timestamp(first, unit="us")], "last_change": [pd.Timestamp(last, unit="us")], "changes": [n]})
            return
        first, last, n = state.get if state.exists else (None, 0, 0)
        for batch in batches:
            times = batch["_at"].astype("datetime64[us]").astype("int64")
            first = int(times.min()) if first is None else min(first, int(times.min()))
            last, n = max(last, int(times.max())), n + len(times)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(last // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))

    timed = changes.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", "0 seconds").select(key, "_at")
    kind = changes.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, created timestamp, last_change timestamp, changes long", "first long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def live(created: Column, now: Column, ttl: int = SESSION_TTL) -> Column:
    """Of epoch seconds: not older than ttl."""
    return now - created <= ttl


def closed_windows(events: DataFrame, at: str, kind: str, width: str, late: str, key: str | None = None) -> DataFrame:
    """window_start, kind, n of windows that the watermark has closed, for the append mode; rows of a key that come again
    while it is remembered count once."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    if key:
        timed = timed.dropDuplicatesWithinWatermark([key])
    return timed.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def run_available(stream: DataFrame, mode: str, checkpoint: str, name: str | None = None) -> DataFrame:
    """All that a stream has now, as a table beside the checkpoint; a run of the same name goes on where the last ended.

    Each batch is written to a partition of its own that a repeated batch overwrites, so every row is there once.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{checkpoint}/{name or f'stream_{uuid.uuid4().hex}'}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number if mode != 'complete' else 0}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").drop("batch")


def split_late(stream: DataFrame, at: str, late: str, checkpoint: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of all that a stream has now: late is what lies before the watermark when it comes.

    The watermark of a batch is the newest time of the batches before it, less `late`. That newest time is one row for
    each batch, stored beside the rows; a repeated batch finds the same one and overwrites what it wrote.
    """
    spark: SparkSession = stream.sparkSession
    folder = f"{checkpoint}/{name or f'late_{uuid.uuid4().hex}'}"
    marks = "newest timestamp, batch int"

    def write(batch: DataFrame, number: int) -> None:
        spark.createDataFrame([], "newest timestamp").write.mode("append").parquet(f"{folder}/marks/batch=-1")
        seen = spark.read.schema(marks).parquet(f"{folder}/marks").where(F.col("batch") < number).agg(F.max("newest").alias("_newest"))
        stamped = F.col(at).cast("timestamp")
        told = batch.join(F.broadcast(seen), F.lit(True)).withColumn("late", F.coalesce(stamped < F.col("_newest") - F.expr(f"interval {late}"), F.lit(False))).drop("_newest")
        told.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")
        batch.agg(F.max(stamped).alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{folder}/rows")
    return tuple(rows.where(F.col("late") == x).drop("late", "batch") for x in (False, True))
