"""The registered queries on the smallest tables against their SQL, by module."""

import os

import pytest

from lodestone.plans import evidence_queries, project_queries, stream_queries, table_queries

DATA = "/root/testdata/sf0.001"
MODULES = (evidence_queries, project_queries, stream_queries, table_queries)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        path = f"{DATA}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(name for m in MODULES for name in m.SQL))
def test_query_equals_sql(spark, duck, name):
    module = next(m for m in MODULES if name in m.SQL)
    found = module.QUERIES[name](spark, DATA)
    cursor = duck.execute(module.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((tuple(r[columns.index(c)] for c in found.columns) for r in cursor.fetchall()), key=repr)
