"""The registered queries of the subpackage on the smallest tables: against SQL, or against held-out labels."""

import os

import pytest

from lodestone.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "conversations", "labels"):
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = llm.queries()[name](spark, DATA)
    cursor = duck.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((tuple(r[columns.index(c)] for c in found.columns) for r in cursor.fetchall()), key=repr)


def test_language_of_held_out_documents(spark, duck):
    langs = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in llm.op3_language_id(spark, DATA).collect() if r["held_out"] and langs[r["doc_id"]]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_sharding_is_balanced(spark, duck):
    rows = llm.op5_sharding(spark, DATA).collect()
    sizes = dict(duck.execute("SELECT doc_id, strlen(coalesce(text, '')) + 16 FROM documents").fetchall())
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    mean, most = sum(sizes.values()) / 40, max(sizes.values())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(abs(sum(r["size"] for r in own) - mean) <= most for own in by.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
