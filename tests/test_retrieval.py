"""Operators around the use of an API: against SQL on the tables, and small cases."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import diff, retrieval
from lodestone.plans import retrieval_queries as rq

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(rq.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = rq.QUERIES[name](spark, SF)
    want = con.execute(rq.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*[f"`{n}`" for n in names]).collect())


def test_import_context(spark):
    cases = [("import a\n\nfrom b import c\nx = 1\ny = 2", "import a\n\nfrom b import c\nx = 1"), ("x = 1\nimport a", ""), ("", ""), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want string").select(retrieval.import_context(F.col("t")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_impact_report(spark):
    node = "report int, id string, file string, name string, parent string, kind string, start_line int, end_line int, source string"
    changed = spark.createDataFrame([(1, "a", "f.py", "go", "C", "function", 1, 2, "def go(): 1")], node)
    impacted = spark.createDataFrame([(1, "m", "g.py", None, None, "module_level", 1, 9, "go()", 1, "calls", []), (1, "b", "g.py", "h", "", "function", 3, 4, "h", 1, "calls go", ["x", "y"])], node + ", depth int, reason string, attributes array<string>")
    text = retrieval.impact_report(changed, impacted).first()["text"]
    assert text == (
        "=== CHANGED CODE ===\nFile: f.py, function: C.go, lines 1-2\ndef go(): 1\n\n"
        "=== DIRECTLY AFFECTED (depth 1) ===\nFile: g.py, function: h, lines 3-4\nNote: calls go; uses return value attributes: [x, y]\nh\n\n"
        "=== MODULE-LEVEL CODE AFFECTED ===\nFile: g.py, function: module_level, lines 1-9\nNote: calls\ngo()"
    )


def test_first_stage(spark):
    one = spark.createDataFrame([(1,), (2,)], "x int")
    assert sorted(tuple(r) for r in retrieval.first_stage([one.where("x > 5"), one.where("x > 1"), one]).select("x", "stage").collect()) == [(2, 1)]
    assert retrieval.first_stage([one.where("x > 5")]).count() == 0


def test_fallback_targets_and_related_reviews(spark):
    usages = spark.createDataFrame([("p", "p"), ("p", "q.a"), ("p", "q.a.b"), ("r", "r.z"), ("r", "s.y")], "package string, usage string")
    assert {tuple(r)[:2] for r in retrieval.review_targets(usages).collect()} == {("p", "q.a.b"), ("r", "r.z")}
    matches = spark.createDataFrame([("f", "impact_review", "a.b.c"), ("g", "impact_review", "ax"), ("h", "removed", "zz")], "file string, type string, api string")
    none = spark.createDataFrame([], "type string, api string")
    proof = spark.createDataFrame([("a.b",)], "api string")
    assert {tuple(r) for r in retrieval.speculative_reviews(matches, none, proof).collect()} == {("f", False), ("g", True), ("h", False)}


def brute_edits(old, new):
    """Kinds of the edit script by plain recursion."""
    from functools import cache

    @cache
    def longest(i, j):
        if i == len(old) or j == len(new):
            return 0
        return 1 + longest(i + 1, j + 1) if old[i] == new[j] else max(longest(i + 1, j), longest(i, j + 1))

    def kinds(i, j):
        if i == len(old) or j == len(new):
            return "-" * (len(old) - i) + "+" * (len(new) - j)
        if old[i] == new[j]:
            return "=" + kinds(i + 1, j + 1)
        return "-" + kinds(i + 1, j) if longest(i + 1, j) >= longest(i, j + 1) else "+" + kinds(i, j + 1)

    return kinds(0, 0)


def test_line_edits():
    rng, sign = random.Random(5), {"same": "=", "removed": "-", "added": "+"}
    for _ in range(400):
        old, new = ([rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(2))
        found = diff.line_edits("\n".join(old), "\n".join(new))
        assert "".join(sign[r["type"]] for r in found) == brute_edits(old, new)
        assert [r["text"] for r in found if r["old_line"]] == old and [r["text"] for r in found if r["new_line"]] == new


def test_line_edits_of_turns(spark):
    rows = rq.QUERIES["q_line_edits"](spark, SF)
    turns = {(r["conv_id"], r["turn"]): r["text"] or "" for r in rq.table(spark, SF, "conversations").collect()}
    want = sum(len(diff.line_edits(t, turns[c, n + 1])) for (c, n), t in turns.items() if (c, n + 1) in turns)
    assert rows.count() == want > 0
