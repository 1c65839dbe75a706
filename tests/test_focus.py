"""Windows and stretches against a search by hand, and stages by key."""

import random
import re

import pytest

from lodestone.operators import focus
from lodestone.plans import evidence_queries
from pyspark.sql import functions as F

REFS = "ref_index int, content string"


def test_offset_map(spark):
    rnd = random.Random(3)
    parts = ["a", "B ", "  ", "\n\n", "\n", "`x`", "``", ":py:func:`~pkg.Name`", ":role:`a  b`", "İ", "é", "\t", ":x:", "~", "```\ncode\n```\n"]
    raws = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(150)] + [None, "`", " "]
    found = focus.mapped_text(spark.createDataFrame(list(enumerate(raws)), "k int, t string"), "k", "t").collect()
    for r in found:
        raw, said = raws[r["key"]] or "", r["said"]
        plain = re.sub(r"\s+", " ", re.sub(r":[A-Za-z_:]+:`~?([^`]+)`", r"\1", raw).replace("`", "")).lower()
        assert re.sub(r" +", " ", said) == plain
        assert r["breaks"] == [m.start() for m in re.finditer(r"(?=\n\n)", raw)]
        ends = [x["said_at"] for x in r["runs"][1:]] + [len(said)] * bool(r["runs"])
        for run, end in zip(r["runs"], ends, strict=True):
            piece = said[run["said_at"] : end]
            assert re.sub(r"\s", " ", raw[run["raw_at"] :][: len(piece)].lower()) == piece or "i̇" in piece


def test_code_spans(spark):
    text = "a\n```py\nx\n~~~\n```\nb\n  ~~~\nopen\n.. code-block:: python\n"
    rst = "t\n.. code-block:: x\n\n   one\n\n   two\nout\n  .. code:: y\n     z\n"
    found = {r["key"]: [(x["s"], x["e"]) for x in r["code"]] for r in focus.mapped_text(spark.createDataFrame([(0, text), (1, rst), (2, "none")], "k int, t string"), "k", "t").collect()}
    cut = lambda t, i: [t[a:b] for a, b in found[i]]
    assert cut(text, 0) == ["```py\nx\n~~~\n```\n", "  ~~~\nopen\n.. code-block:: python\n"]
    assert cut(rst, 1) == [".. code-block:: x\n\n   one\n\n   two\n", "  .. code:: y\n     z\n"] and found[2] == []


def by_hand(text, term, size):
    """Windows around one plain word, without code."""
    out = set()
    half = max(size, 800) // 2
    for m in re.finditer(rf"(?<![\w.]){re.escape(term)}(?![\w.])", text.lower()):
        at = m.start()
        s, e = max(0, at - half), min(len(text), at + len(term) + half)
        p, q = text.rfind("\n\n", 0, s), text.find("\n\n", e)
        s = p + 2 if p >= 0 and at - p <= 2 * half else s
        e = q if q >= 0 and q - at <= 2 * half else e
        out.add((s, e))
    return out


def test_api_windows(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "pkg.Client", "x"])
    texts = ["".join(word() + rnd.choice([" ", " ", ".\n", "\n\n", ", "]) for _ in range(n)).strip() for n in (0, 5, 400, 900)]
    fenced = "intro `pkg.Client` " + "w " * 180 + "\n```\n" + "code line\n" * 60 + "```\n" + "tail " * 300
    rows = list(enumerate([*texts, None, fenced]))
    refs = spark.createDataFrame(rows, REFS)
    terms = spark.createDataFrame([("pkg.Client",), ("gamma",), ("PKG.client",), ("",), ("none.here",)], "term string")
    found = focus.api_windows(refs, terms, size=900).collect()
    got = {}
    for r in found:
        got.setdefault(r["ref_index"], set()).add((r["start"], r["end"]))
        text = rows[r["ref_index"]][1].strip()
        assert r["line_start"] == text[: r["start"]].count("\n") + 1 and r["line_end"] == r["line_start"] + text[r["start"] : r["end"]].count("\n")
        assert text[r["start"] : r["end"]].strip().startswith(r["content"][:1200])
    for i in range(4):
        assert got.get(i, set()) == by_hand(texts[i], "pkg.client", 900) | by_hand(texts[i], "gamma", 900)
    # The window ends inside the block, so it goes on to its end; the name's offset is that of the raw text.
    (start, end), = got[5]
    assert start == 0 and fenced[:end].endswith("```\n") and end < len(fenced)
    assert sum(len(v) for v in got.values()) == len(found)


def test_stages_work_on_what_is_left(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "package string")
    seen = []

    def stage(name, gives):
        def run(left):
            seen.append((name, sorted(r[0] for r in left.collect())))
            return left.where(F.col("package").isin(*gives)).withColumn("content", F.lit(name))

        return run

    rows = focus.staged(keys, [stage("one", ["b"]), stage("two", ["a", "b"]), stage("three", ["a", "b", "z"])])
    assert {tuple(r) for r in rows.collect()} == {("b", "one", 0), ("a", "two", 1)}
    assert seen == [("one", ["a", "b", "c"]), ("two", ["a", "c"]), ("three", ["c"])]


def test_focused_snippets(spark):
    text = "Intro. " * 200 + "Client.fetch was removed. " + "More. " * 400 + "fetch again" + " end" * 300
    docs = [
        ("p", 1, "Notes", "http://1", "web", text, None), ("p", 2, "Notes", "http://1", "web", text, None), ("p", 3, "Old", "http://2", "web", text, "old_api_docs"), ("p", 4, "Notes", "http://4", "web", "fetch is nice", None),
        ("q", 1, "Notes", "http://1", "web", "Client.fetch", None), ("r", 1, "Notes", "http://1", "web", "breaking: removed", None), ("s", 1, "Notes", "http://1", "web", "breaking: removed; fetch must go", None),
    ]
    refs = spark.createDataFrame(docs, "package string, ref_index int, title string, url string, source string, content string, role string")
    terms = spark.createDataFrame([("p", "Client.fetch", True), ("p", "fetch", False), ("s", "fetch", True), ("r", "zzz", True)], "package string, term string, strong boolean")
    in_code = spark.createDataFrame([("p",), ("s",)], "package string")
    found = focus.focused_snippets(refs, terms, in_code, lambda r: r.where("package = 'q'"), lambda r: r.where("content like 'breaking%'")).collect()
    rows = {(r["package"], r["ref_index"]): (r["stage"], r["content"]) for r in found}
    assert set(rows) == {("q", 1), ("r", 1), ("s", 1), ("p", 1)} and {k: v[0] for k, v in rows.items()} == {("q", 1): 0, ("r", 1): 1, ("s", 1): 2, ("p", 1): 2}
    pieces = rows["p", 1][1].split("\n\n---\n\n")
    assert len(pieces) == 2 and all(x.startswith("... ") and x.endswith(" ...") for x in pieces) and "Client.fetch was removed" in pieces[0] and "fetch again" in pieces[1]
    at = text.index("Client.fetch")
    assert pieces[0] == "... " + text[at - 900 : at + len("Client.fetch") + 900].strip() + " ..."


def test_term_stretches_of_odd_texts_equal_sql(spark, tmp_path):
    """A term that overlaps itself, and letters whose lower case is longer, before and in terms."""
    duckdb = pytest.importorskip("duckdb")
    pad = "x " * 600
    texts = [pad + "ananananananan " + pad, pad + "İİİ ananan " + pad, pad + "İ" * 40 + " ananan", "😀 ananan " + pad, "kelvins stanbul lmnopq fghijki fghijkİlmnopq " + pad, None, "", pad + "anananan", "\t ANANAN Kelvins \n"]
    items = ["Ananan and", "Kelvins İstanbul", "fghijkİlmnopq", None]
    spark.createDataFrame([(5 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5 * i, t) for i, t in enumerate(items)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect(config={"threads": 1})
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(evidence_queries.SQL["q_term_stretches"]).fetchall()
    found = evidence_queries.QUERIES["q_term_stretches"](spark, str(tmp_path)).collect()
    assert len(want) == 7 and sorted(map(tuple, found)) == sorted(want)
