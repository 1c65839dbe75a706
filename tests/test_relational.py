"""Generic operators on edge cases; every registered query against its SQL on the smallest tables."""

import os
import random

import pytest

from lodestone.operators import graph, intervals, prefix
from lodestone.operators import relational as rel
from lodestone.plans import driver_queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in sorted(os.listdir(DATA)):
        path = f"{DATA}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(driver_queries.SQL))
def test_query_equals_sql(spark, duck, name):
    found = driver_queries.QUERIES[name](spark, DATA)
    cursor = duck.execute(driver_queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in found.columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in found.collect()), key=repr) == want


def test_prefixes_and_specific(spark):
    df = spark.createDataFrame([("a.b",), ("a.b.c",), ("a.bc",), ("a::x",), ("a",), (None,)], "u string")
    assert {r["u"] for r in rel.prefer_specific(df.where("u is not null"), "u", [".", "::"]).collect()} == {"a.b.c", "a.bc", "a::x"}
    allowed = spark.createDataFrame([("a.b",)], "u string")
    assert {r["u"] for r in rel.allowed_by_prefix(df, "u", allowed, ".").collect()} == {"a.b", "a.b.c"}


def test_rollups(spark):
    df = spark.createDataFrame([(1, "passed"), (1, "timeout"), (2, "skipped"), (2, "skipped"), (3, "skipped"), (3, "passed")], "k int, s string")
    found = {r["k"]: r["x"] for r in df.groupBy("k").agg(rel.check_status(F.col("s").isin("failed", "timeout"), F.col("s") == "skipped").alias("x")).collect()}
    assert found == {1: "failed", 2: "skipped", 3: "passed"}
    graded = spark.createDataFrame([(1, "low"), (1, "high"), (2, None), (3, "medium"), (3, "odd")], "k int, c string")
    assert {r["k"]: r["x"] for r in graded.groupBy("k").agg(rel.best_of(F.col("c"), ["low", "medium", "high"], "none").alias("x")).collect()} == {1: "high", 2: "none", 3: "medium"}


def test_precedence_and_default(spark):
    df = spark.createDataFrame([("a", 2, 0, "late"), ("a", 1, 0, None), ("a", 2, 1, "later"), ("b", 3, 0, "only"), ("c", 1, 0, None)], "k string, p int, o int, v string")
    assert {r["k"]: r["v"] for r in rel.resolve_by_precedence(df, "k", "v", ["p", "o"]).collect()} == {"a": "late", "b": "only"}
    versions = spark.createDataFrame([("x", 0, "1", False), ("x", 1, "2", True), ("x", 2, "3", True), ("y", 0, "1", False), ("y", 1, "2", False)], "k string, o int, v string, d boolean")
    assert {r["k"]: r["v"] for r in rel.default_else_last(versions, "k", "v", ["o"], F.col("d")).collect()} == {"x": "2", "y": "2"}


def test_containments_in_blocks(spark):
    docs = spark.createDataFrame([(1, "Concatenate the Foo bar"), (2, "none"), (3, None)], "d int, t string")
    terms = spark.createDataFrame([(1, "cat"), (2, "foo ba"), (3, ""), (4, "zzz"), (5, "NONE")], "i int, w string")
    want = {(1, 1), (1, 2), (2, 5)}
    for block in (1, 2, 100):
        assert {tuple(r) for r in rel.containments(docs, "d", "t", terms, "i", "w", most_terms=block).collect()} == want


def test_containments_of_long_terms(spark):
    said = ["The quick, brown fox jumps -- over the lazy dog", "xquick, brown foxes", "a b c d e f g h", "b c d", None, "brown fox jumps"]
    wanted = ["quick, brown fox", "ick, brown fo", "b c d", "b c d e f g", "brown  fox jumps", "fox jumps -- over the la", ", brown fox", "a b c d e f g h", "h i j"]
    docs = spark.createDataFrame(list(enumerate([*said, said[0]])), "d int, t string")
    terms = spark.createDataFrame(list(enumerate(wanted)), "i int, w string")
    want = sorted((d, i) for d, t in enumerate([*said, said[0]]) for i, w in enumerate(wanted) if t and w in t.lower())
    assert sorted(tuple(r) for r in rel.containments(docs, "d", "t", terms, "i", "w").collect()) == want and len(want) > 10
    plan = rel.containments(docs, "d", "t", terms.where("i = 0"), "i", "w")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_documents_reach_terms_overlap_and_diff(spark, tmp_path):
    long = " ".join(f"word{i % 7}x" for i in range(30_000))
    spark.createDataFrame([(1, "The parser parses parsed trees, and the parser walks trees"), (2, long), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "parsing trees walking"), (8, "nothing here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(1, 0, "user", "a\nb\nc"), (1, 2, "assistant", "a\nc\nd"), (1, 3, "user", None), (2, 0, "user", "a")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    top = driver_queries.q_ngram_top20_documents(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in top} == {1, 2} and not any(w in r["term"].split() for r in top for w in ("the", "and"))
    assert [(r["term"], r["weight"]) for r in top if r["doc_id"] == 1 and r["place"] == 1] == [("parser parses parsed", 3)]
    assert {r["weight"] for r in top if r["doc_id"] == 2 and r["place"] <= 7} <= {3 * 4285, 3 * 4286}
    assert {tuple(r) for r in driver_queries.q_fuzzy_overlap_documents(spark, str(tmp_path)).collect()} == {(1, 7, 3)}
    assert {tuple(r) for r in driver_queries.q_line_diff(spark, str(tmp_path)).collect()} == {(1, 2, 2), (1, 3, 0)}


def test_all_rows_reach_the_graph(spark, tmp_path):
    parts = [(i, f"n{i % 5}", f"b{i % 3}", 1 + i % 9) for i in range(1, 60)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["caller"]: r["resolved"] for r in driver_queries.q_call_resolve_all(spark, str(tmp_path)).collect()}
    assert found == {k: min((b != brand, j) for j, s, b, _ in parts if s == sym and j != k)[1] for k, sym, brand, _ in parts}
    lines = spark.createDataFrame([(1, i, 10 + i, i) for i in (1, 2, 3)], "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity int")
    for c in ("l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"):
        lines = lines.withColumn(c, F.lit(0))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in driver_queries.q_graph_edges_all(spark, str(tmp_path)).collect()} == {(11, 12), (12, 13)}


def test_char_budget_and_caps(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate((40, 50, 30, 5))], "s string, i int, n int")
    assert [(r["i"], r["used"]) for r in rel.char_budget(df, ["s"], ["i"], "n", 100, 5).orderBy("i").collect()] == [(0, 40), (1, 50), (2, 10)]
    assert [(r["i"], r["used"]) for r in rel.char_budget(df, ["s"], ["i"], "n", 100, 10).orderBy("i").collect()] == [(0, 40), (1, 50)]


def test_intervals(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 6), ("k", 7, 9), ("k", 1, 2), ("j", 0, 1)], "k string, s long, e long")
    assert {tuple(r) for r in intervals.merge_intervals(df, ["k"], "s", "e").collect()} == {("k", 0, 6, 3), ("k", 7, 9, 1), ("j", 0, 1, 1)}
    points = spark.createDataFrame([("k", p, p) for p in (1, 4, 8, 10)], "k string, p long, id long")
    found = {r["id"]: (r["s"], r["e"]) for r in intervals.innermost(points, F.col("p"), df, ["k"], "s", "e", ["id"], ["s"]).collect()}
    assert found == {1: (1, 2), 4: (0, 5), 8: (7, 9)}


def test_best_terms(spark, monkeypatch):
    """Counting inside rows gives what counting by key gives, for keys of one row and of several."""
    rnd = random.Random(6)
    vocabulary = ["a", "bb", "ccc", "été", "word", "longer"]
    rows = [(i if i % 7 else 0, [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 40]))]) for i in range(60)] + [(None, ["x"]), (900, None), (901, ["long phrase", "long phrase"])]
    df = spark.createDataFrame(rows, "k int, words array<string>")
    want = {(r["k"], r["term"], r["weight"], r["rank"]) for r in rel.top_terms(rel.ngram_weights(df, "k", "words"), "k", 9).collect()}
    for step in (1, 1 << 18):
        monkeypatch.setattr(rel, "STEP_WORDS", step)
        found = [tuple(r) for r in rel.best_terms(df, "k", "words", 9).collect()]
        assert len(found) == len(want) and set(found) == want


def test_hot_keys_go_by_ranges(spark, monkeypatch):
    """Running values over ranges of rows equal those of a window."""
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "hot", "x", None]), rnd.randint(0, 3000), i) for i in range(1500)]
    df = spark.createDataFrame([(k, s, s + rnd.choice([0, 1, 2, 400] if s < 200 else [0, 1, 2]), i) for k, s, i in rows], "k string, s long, e long, i int").cache()
    whole = [{tuple(r) for r in f().collect()} for f in (lambda: intervals.merge_intervals(df, ["k"], "s", "e"), lambda: rel.char_budget(df, ["k"], ["s", "i"], "e", 90_000, 10), lambda: rel.nested_budget(df, ["k"], ["s"], ["i"], "e", 900, 20_000, 5))]
    monkeypatch.setattr(prefix, "MOST_IN_WINDOW", 10)
    ranged = [{tuple(r) for r in f().collect()} for f in (lambda: intervals.merge_intervals(df, ["k"], "s", "e"), lambda: rel.char_budget(df, ["k"], ["s", "i"], "e", 90_000, 10), lambda: rel.nested_budget(df, ["k"], ["s"], ["i"], "e", 900, 20_000, 5))]
    assert whole == ranged and all(whole)


def test_prefix_sums(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "a", "a", "b", "c"]), i if rnd.random() > 0.1 else None, rnd.choice([None, 1, 2, 3]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o int, v int, part int")
    found = {r["part"]: (r["s"], r["n"]) for r in prefix.prefix_sums(df, ["k"], ["o", "part"], {"s": F.col("v"), "n": F.lit(1)}, 7).collect()}
    high = {r["part"]: r["m"] for r in prefix.prefix_maxima(df, ["k"], ["o", "part"], {"m": F.col("v")}, 7).collect()}
    so_far = {}
    for k, _, v, i in sorted(rows, key=lambda x: (x[0] or "", x[1] is not None, x[1] or 0, x[3])):
        total, n, most = so_far.get(k, (0, 0, None))
        assert found[i] == (total, n) and high[i] == most
        so_far[k] = (total + (v or 0), n + 1, max((x for x in (most, v) if x is not None), default=None))
    assert [r["s"] for r in prefix.prefix_sums(df, [], ["part"], {"s": F.lit(1)}, 5).orderBy("part").collect()] == list(range(400))
    assert prefix.prefix_sums(df.limit(0), ["k"], ["part"], {"s": F.col("v")}).count() == 0


def test_stabbed_spans(spark):
    rnd = random.Random(4)
    spans = [(rnd.choice("ab"), s, s + rnd.choice([-1, 0, 1, 7, 64, 5000, 10**12]), i) for i, s in enumerate(rnd.choices(range(-500, 9000), k=120))]
    points = [(rnd.choice("ab"), rnd.randint(-600, 12_000), i) for i in range(150)]
    a, b = spark.createDataFrame(points, "k string, p long, id int"), spark.createDataFrame(spans, "k string, s long, e long, n int")
    found = intervals.stabbed(a, F.col("p"), b, ["k"], "s", "e").select("id", "n").collect()
    want = {(i, n) for k, p, i in points for j, s, e, n in spans if k == j and s <= p <= e}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_reach_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 3), (5, 4), (3, 3)], "source int, target int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {tuple(r) for r in graph.reverse_reach(edges, seeds, 3).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert {tuple(r) for r in graph.degrees(edges.select(F.col("source").alias("n")).distinct(), edges, "n").collect()} == {(1, 2), (2, 3), (3, 4), (4, 2), (5, 1)}


def test_overlaps_count_pairs_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(rel, "OVERLAP_ROWS", 5)
    monkeypatch.setattr(rel, "OVERLAP_OTHERS", 3)
    rnd = random.Random(9)
    many, few = ([(i, rnd.choices("abcdefgh", k=rnd.randrange(7))) for i in range(n)] for n in (40, 10))
    many.append((3, ["a", "b", "h"]))
    of = lambda rows: {i: set().union(*(w for j, w in rows if j == i)) for i, _ in rows}
    want = {(i, j, len(a & b)) for i, a in of(many).items() for j, b in of(few).items() if len(a & b) >= 3}
    left, right = spark.createDataFrame(many, "i int, w array<string>"), spark.createDataFrame(few, "j int, w array<string>")
    assert sorted(tuple(r) for r in rel.overlaps(left, "i", right, "j", "w", 3).collect()) == sorted(want)
    monkeypatch.undo()
    # Pairs are not dealt out again.
    plan = driver_queries.QUERIES["q_fuzzy_overlap_documents"](spark, DATA)._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "item_id" in x]
