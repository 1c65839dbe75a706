"""Diffs, reviews and merges on small texts; properties by random edits."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import diff
from pyspark.sql import functions as F

TEXT = "\n".join(f"line {i}" for i in range(30)) + "\n"
PATCHED = TEXT.replace("line 3\n", "LINE 3\nextra\n").replace("line 25\n", "")

texts = st.lists(st.sampled_from(["a", "b", "c", "", "x y"]), max_size=12).map("\n".join)


def frame(spark, *rows):
    return spark.createDataFrame(rows, "k int, original string, patched string, rejected array<string>")


def test_hunks_and_counts(spark):
    df = frame(spark, (1, TEXT, PATCHED, []), (2, None, "new\n", []), (3, TEXT, TEXT, [])).withColumn("hunks", diff.hunks("original", "patched"))
    found = {r["k"]: r["hunks"] for r in df.collect()}
    assert [(h["hunk_id"], h["old_start"], h["old_lines"], h["new_start"], h["new_lines"]) for h in found[1]] == [("hunk_001", 1, 7, 1, 8), ("hunk_002", 23, 7, 24, 6)]
    assert len(found[2]) == 1 and found[3] == []
    assert {r["k"]: (r["additions"], r["deletions"]) for r in diff.change_counts(df, "k").collect()} == {1: (2, 2), 2: (1, 0), 3: (0, 0)}


def test_partial_apply_and_merge(spark):
    df = frame(spark, (1, TEXT, PATCHED, []), (2, TEXT, PATCHED, ["hunk_001", "hunk_002"]), (3, TEXT, PATCHED, ["hunk_002"]))
    found = {r["k"]: r["x"] for r in df.select("k", diff.partial_apply("original", "patched", "rejected").alias("x")).collect()}
    assert found == {1: PATCHED, 2: TEXT, 3: TEXT.replace("line 3\n", "LINE 3\nextra\n")}
    merged = df.limit(1).select(diff.delta_merge("original", "patched", F.lit(TEXT.replace("line 10\n", "mine\n"))).alias("x")).first()["x"]
    assert merged == PATCHED.replace("line 10\n", "mine\n")


@settings(max_examples=200, deadline=None)
@given(texts, texts)
def test_apply_properties(a, b):
    every = {h["hunk_id"] for h in diff.hunk_rows(a, b)}
    assert diff.apply_accepted(a, b, set()).splitlines() == b.splitlines()
    assert diff.apply_accepted(a, b, every).splitlines() == a.splitlines()
    assert diff.replay_delta(a, b, a).rstrip("\n") == b.rstrip("\n")
    assert diff.common_lines(a, b) == diff.common_lines(b, a) <= min(len(a.split("\n")), len(b.split("\n")))


def test_replay_keeps_line_ends():
    assert diff.replay_delta("a\r\nb\r\nc", "a\r\nB\r\nc", "A\r\nb\r\nc") == "A\r\nB\r\nc"
    assert diff.replay_delta("a\r\n", "a\r\nb", "a\r\n") == "a\r\nb" and diff.replay_delta("a\n", "a\n", "other") == "other"
    assert [c["type"] for c in diff.hunk_rows("a\nb\n", "a\nc\n")[0]["changes"]] == ["context", "deletion", "addition"]


@settings(max_examples=100, deadline=None)
@given(texts, texts)
def test_hunks_are_those_of_grouped_differences(a, b):
    import difflib

    groups = difflib.SequenceMatcher(None, a.splitlines(), b.splitlines()).get_grouped_opcodes(diff.CONTEXT)
    found = [(h["old_start"] - 1, h["old_lines"], h["new_start"] - 1, h["new_lines"]) for h in diff.hunk_rows(a, b)]
    assert found == [(g[0][1], g[-1][2] - g[0][1], g[0][3], g[-1][4] - g[0][3]) for g in groups]


def test_common_lines(spark):
    assert frame(spark, (1, "a\nb\nc", "b\nx\nc", [])).select(diff.shared_lines("original", "patched").alias("x")).first()["x"] == 2


def test_splice(spark):
    kind = "array<struct<start_line:int,end_line:int,replacement:string>>"
    rows = [("a\nb\nc\nd\n", [(2, 3, "X\nY\n"), (9, 9, "no")]), ("a\nb", [(1, 1, "Z")]), ("a\n", [])]
    df = spark.createDataFrame(rows, f"content string, r {kind}").select(diff.splice(F.col("content"), F.col("r")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["a\nX\nY\nd\n", "Z\nb", "a\n"]


def test_merged_blocks(spark):
    rows = [("f", 1, 10, "function", "a"), ("f", 10, 20, "function", "a"), ("f", 21, 22, "class", "b"), ("f", 22, 30, "method", "c"), ("g", 1, 2, "class", "d")]
    found = sorted(tuple(r) for r in diff.merged_blocks(spark.createDataFrame(rows, "file string, start_line int, end_line int, context_type string, name string")).collect())
    assert found == [("f", 1, 20, "function", "a"), ("f", 21, 30, "merged_block", None), ("g", 1, 2, "class", "d")]


def test_error_locations(spark):
    text = 'File "a.py", line 3\n  --> src/x.rs:4:5\nb.ts(7,2): bad\n' + "".join(f"c.go:{i}:1\n" for i in range(9))
    found = [(r["file"], r["line"]) for r in diff.error_locations(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()]
    assert ("a.py", 3) in found and ("src/x.rs", 4) in found and ("b.ts", 7) in found and len([f for f in found if f[0] == "c.go"]) == 6


def test_first_json_object(spark):
    rows = ['x {bad} ```json\n{"b": 1, "a": {"c": "}"}}\n``` {"z": 2}', "none", None]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select(diff.first_json_object("t").alias("x")).collect()
    assert [r["x"] for r in found] == ['{"a": {"c": "}"}, "b": 1}', None, None]


def test_random_edits_keep_line_numbers():
    rnd = random.Random(1)
    for _ in range(50):
        a = [rnd.choice("abcdef") for _ in range(40)]
        b = [x for x in a if rnd.random() > 0.1] + ["new"]
        for h in diff.hunk_rows("\n".join(a), "\n".join(b)):
            for c in h["changes"]:
                if c["type"] != "addition":
                    assert a[c["line_number_old"] - 1] == c["content"]
                if c["type"] != "deletion":
                    assert b[c["line_number_new"] - 1] == c["content"]
