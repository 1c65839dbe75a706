"""Streams against their batch counterparts."""

import datetime as dt
import json
import os

from lodestone.streaming import progress, sandbox


def stream_of(spark, tmp_path, rows, schema, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        for file in (tmp_path / f"in/p{i}").glob("part-*"):  # files are taken in order of their times
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_sse_events(spark):
    block = "event: x\ndata: " + json.dumps({"event": "progress", "phase": "scan", "total_files": 3}) + "\n\ndata: {bad\n\ndata: " + json.dumps({"phase": "Completed", "success": True}) + "\n\n"
    found = progress.sse_events(spark.createDataFrame([(block,), (None,), ("",)], "value string")).collect()
    assert [(r["event"], r["phase"], r["total_files"], r["success"]) for r in found] == [("progress", "scan", 3, None), (None, "Completed", None, True)]


def test_late_rows_and_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(t, "a"), (t + dt.timedelta(minutes=70), "a"), (t + dt.timedelta(hours=9), "b"), (t + dt.timedelta(minutes=5), "a"), (t + dt.timedelta(hours=9, minutes=5), "b")]
    schema = "ts timestamp_ntz, kind string"
    stream = stream_of(spark, tmp_path, rows, schema, [[0, 1], [2], [4], [3]])
    out = progress.run_available(progress.progress_counts(stream, "ts", "kind", "1 hour", "2 hours"), "append", f"{tmp_path}/c")
    # The last row comes after its window was closed; lateness is judged by the batch before.
    assert {(r["window_start"].hour, r["kind"], r["n"]) for r in out.collect()} >= {(12, "a", 1), (13, "a", 1)}
    batch = progress.user_sessions(spark.createDataFrame(rows, schema), "ts", "kind", "30 minutes", "1 hour").collect()
    assert sorted((r["kind"], r["n"]) for r in batch) == [("a", 1), ("a", 2), ("b", 2)]


def test_sessions_expire(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("s1", t), ("s1", t + dt.timedelta(seconds=1700)), ("s2", t + dt.timedelta(seconds=3000)), ("s3", t + dt.timedelta(hours=9)), ("s3", t + dt.timedelta(hours=10))]
    stream = stream_of(spark, tmp_path, rows, "session string, ts timestamp", [[0], [1, 2], [3], [4]])
    out = progress.run_available(progress.expire_sessions(stream, "session", "ts"), "append", f"{tmp_path}/c")
    found = {r["session"]: (r["changes"], (r["last_change"] - r["created"]).total_seconds()) for r in out.collect()}
    assert found["s1"] == (2, 1700) and found["s2"] == (1, 0)


def test_closed_windows_and_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, t, "a"), (2, t + dt.timedelta(minutes=70), "a"), (1, t, "a"), (3, t + dt.timedelta(hours=9), "b"), (4, t + dt.timedelta(minutes=5), "a"), (5, t + dt.timedelta(hours=9, minutes=5), "b")]
    stream = stream_of(spark, tmp_path, rows, "id int, ts timestamp_ntz, kind string", [[0, 1, 2], [3], [5], [4]])
    out = progress.run_available(progress.closed_windows(stream, "ts", "kind", "1 hour", "2 hours", "id"), "append", f"{tmp_path}/c")
    assert {(r["window_start"].hour, r["kind"], r["n"]) for r in out.collect()} == {(12, "a", 1), (13, "a", 1)}
    on_time, late = progress.split_late(stream, "ts", "2 hours", f"{tmp_path}/c")
    assert {r["id"] for r in late.collect()} == {4} and sorted(r["id"] for r in on_time.collect()) == [1, 1, 2, 3, 5]


def write_files(spark, tmp_path, rows, schema, parts):
    for i, part in parts.items():
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
        for file in (tmp_path / f"in/p{i}").glob("part-*"):
            os.utime(file, (1_700_000_000 + 60 * i,) * 2)


def test_sandbox_sessions_go_on_after_a_restart(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [
        ("ok", 0, "patch", "a.py", None, None, at(0)), ("ok", 1, "verify", None, "passed", None, at(1)), ("ok", 2, "verify", None, "failed", "x", at(2)),
        ("none", 0, "verify", None, "failed", "x", at(0)),
        ("fix", 2, "verify", None, "failed", "pytest", at(1)), ("fix", 0, "patch", "a.py", None, None, at(0)), ("fix", 1, "patch", "b.py", None, None, at(0)),
        ("bad", 0, "patch", "a.py", None, None, at(0)), ("bad", 1, "verify", None, "failed", "ruff, pytest", at(1)), ("bad", 2, "repair", None, "partial", "pytest", at(2)), ("bad", 3, "repair", None, "success", "pytest", at(3)), ("bad", 4, "repair", None, "success", None, at(4)),
        ("gone", 0, "patch", "a.py", None, None, at(0)), ("gone", 2, "verify", None, "passed", None, at(1)),
        ("fix", 4, "repair", None, "success", None, at(6)), ("fix", 3, "repaired", "b.py", None, None, at(5)),
        ("later", 0, "verify", None, "skipped", None, at(600)), ("last", 0, "verify", None, "skipped", None, at(700)),
    ]
    schema = "session string, ord int, kind string, file string, status string, checks string, at timestamp"
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = lambda: progress.run_available(sandbox.sandbox_phases(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), attempts=2), "append", f"{tmp_path}/c", "sandbox")
        write_files(spark, tmp_path, rows, schema, {0: [0, 1, 3, 4, 7, 8, 12, 13], 1: [5, 6, 9, 2]})
        first = run()
        assert "repair_done" not in {r["event"] for r in first.where("session = 'fix'").collect()}
        # The second run is a new query: what the sessions said before is in their state alone.
        write_files(spark, tmp_path, rows, schema, {2: [10, 14], 3: [15, 11], 4: [16], 5: [17]})
        found = {}
        for r in sorted(run().collect(), key=lambda r: (r["session"], r["place"])):
            found.setdefault(r["session"], []).append(r)
    finally:
        spark.conf.unset(key)
    events = {k: [r["event"] for r in v] for k, v in found.items()}
    assert events["ok"] == ["phase", "verify_done", "done"] and events["none"] == ["done"]
    assert events["fix"] == ["phase", "verify_fail", "phase", "repair_attempt", "repair_done", "done"] and found["fix"][4]["files"] == ["b.py"]
    assert events["bad"] == ["phase", "verify_fail", "phase", "repair_attempt", "repair_attempt", "repair_fail", "done"]
    assert events["gone"] == ["error"]
    assert all([r["place"] for r in v] == list(range(len(v))) for v in found.values())
    assert all(sum(e in ("done", "error") for e in v) == 1 for v in events.values())
