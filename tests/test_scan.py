"""Phrases found where texts are read, and the queries that find theirs so."""

import random
import re

import pytest

from lodestone.operators import positions, scan
from lodestone.plans import evidence_queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("how", [positions.ANYWHERE, positions.WORDS, positions.NAMES])
def test_text_places(spark, how, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 3)
    rnd = random.Random(5)
    said = ["".join(rnd.choice(["a", "b", "ab", ".", " ", "é", "-"]) for _ in range(rnd.randrange(60))) for _ in range(80)] + [None, ""]
    wanted = ["a", "ab", "a b", "b.a", ".a", "aba", "é", "a-", "-", "bb"]
    edge = {positions.ANYWHERE: ("", ""), positions.WORDS: (r"(?<!\w)", r"(?!\w)"), positions.NAMES: (r"(?<![\w.])", r"(?![\w.])")}[how]
    want = {(i, p, m.start()) for i, t in enumerate(said) for p in wanted if p != "-" for m in re.finditer(f"(?={edge[0]}{re.escape(p)}{edge[1]})", t or "")}
    texts = spark.createDataFrame(list(enumerate(said)), "k int, t string")
    rows = scan.text_places(texts, "k", "t", spark.createDataFrame([(p,) for p in wanted], "phrase string"), how).collect()
    assert {(r["key"], r["phrase"], r["at"]) for r in rows} == want and len(rows) == len(want) and all(r["end"] - r["at"] == len(r["phrase"]) for r in rows)


def test_text_places_of_groups(spark, monkeypatch):
    monkeypatch.setattr(scan, "GIVEN", 2)
    texts = spark.createDataFrame([(1, "x y x x", 0), (2, "x y", 1)], "k int, t string, g int")
    phrases = spark.createDataFrame([("x", 0), ("y", 1)], "phrase string, g int")
    assert sorted(tuple(r) for r in scan.text_places(texts, "k", "t", phrases, group="g").collect()) == [(1, "x", 0, 1), (1, "x", 4, 5), (1, "x", 6, 7), (2, "y", 2, 3)]


@pytest.mark.parametrize("name", ["q_keyword_migrations", "q_method_scores", "q_term_stretches", "q_api_windows", "q_supporting_references"])
def test_no_index_of_all_positions_is_written(spark, name):
    made = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("positions_")}
    before = made()
    assert evidence_queries.QUERIES[name](spark, DATA).agg(F.count(F.lit(1))).first() is not None
    assert made() == before
