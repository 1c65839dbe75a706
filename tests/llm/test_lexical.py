"""Ranked search against scoring every document, and treaps against their definition."""

import math
import random
import re
from collections import Counter
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import lexical

DOCS = "doc_id long, text string, item_id int, score string"
ITEMS = "item_id string, text string, doc_id int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    said = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [(i, c, sum(c.values())) for i, c in said]
    n_docs, n_terms = sum(n > 0 for _, _, n in sizes), sum(n for _, _, n in sizes)
    df = Counter(t for _, c, _ in sizes for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in sizes:
            m = 50 + 50 * n * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def corpus():
    rnd = random.Random(11)
    vocabulary = ["the", "of", "É", "Straße", "x1", "Zoo"] + [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    say = lambda n: " ".join(rnd.choices(vocabulary, weights, k=n))
    docs = [(i, say(rnd.randint(0, 60))) for i in range(500)]
    docs += [(i, "the of the of") for i in range(600, 680)]  # ties beyond k
    docs += [(3, say(20)), (3, "the zoo"), (3, "the zoo"), (None, "the zoo"), (None, None), (700, None), (701, ""), (702, "--- !!"), (703, say(40_000))]
    items = [(str(i), say(n)) for i, n in enumerate([1, 2, 5, 30, 60, 0, 400])] + [("none", None), ("zz", "absent words"), ("3", say(4)), (None, "the THE Zoo")]
    return docs, items


@pytest.mark.parametrize(("segment", "leaf", "block", "cells"), [(8 << 20, 64, 1 << 18, 1 << 16), (3000, 1, 150, 64)])
def test_search(spark, monkeypatch, segment, leaf, block, cells):
    for name, value in (("SEGMENT_BYTES", segment), ("LEAF", leaf), ("BLOCK_TERMS", block), ("CELLS", cells)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus()
    tables = spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    found = lexical.ranked_search(*tables, k=20).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found) == brute(docs, items, 20)


def test_index_is_written_in_small_row_groups(spark, monkeypatch):
    """A task that writes many segments holds a few of them at a time, and nothing of those it has written."""
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 3000)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50)), 1, "s") for i in range(300)], DOCS).coalesce(1)
    index = lexical.build_index(docs, 300, 15_000)
    (file,) = index.inputFiles()
    stored = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    groups = [stored.row_group(i) for i in range(stored.num_row_groups)]
    assert stored.num_rows == index.count() > 10
    assert max(g.num_rows for g in groups) <= 2
    assert not any(g.column(i).is_stats_set and g.column(i).statistics.has_min_max for g in groups for i in range(g.num_columns))
    assert sorted(i for r in index.collect() for i in np.frombuffer(r["ids"], np.int64)) == list(range(300))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "s")], DOCS), spark.createDataFrame([("1", "a", 1)], ITEMS)
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical.ranked_search(docs, spark.createDataFrame([("1", "...", 1)], ITEMS)).count() == 0


def test_treaps():
    rnd = np.random.default_rng(4)
    lists = np.sort(rnd.integers(0, 30, 2000))
    for impact in (rnd.integers(0, 6, 2000), np.arange(2000), -np.arange(2000), np.zeros(2000, int)):
        impact = impact.astype(np.int32)
        left, right, roots = lexical.build_treaps(impact, lists)

        def walk(node):
            """Postings below in order; a child's impact is never above its parent's."""
            out, stack = [], []
            while stack or node >= 0:
                while node >= 0:
                    stack.append(node)
                    assert left[node] < 0 or impact[left[node]] <= impact[node]
                    node = left[node]
                node = stack.pop()
                out.append(node)
                assert right[node] < 0 or impact[right[node]] <= impact[node]
                node = right[node]
            return out

        assert [walk(r) for r in roots] == [list(np.flatnonzero(lists == x)) for x in np.unique(lists)]
