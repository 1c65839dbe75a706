"""Addresses, the parse cache and table functions."""

import pytest

from lodestone.functions import tables
from lodestone.operators import addresses, parse_cache
from lodestone.plans import driver_queries, project_queries
from pyspark.sql import functions as F


def urls(df):
    return [r["url"] for r in df.orderBy("package", "place").collect()]


def test_old_pages(spark):
    packages = spark.createDataFrame([("serde", "cargo", "1.2.0"), ("org.x:lib", "maven", "3.1"), ("plain", "pip", "2.0"), ("none", "pip", "")], "package string, ecosystem string, version string")
    bases = spark.createDataFrame([("plain", "https://b.dev/docs/"), ("plain", "https://a.dev"), ("plain", "https://a.dev/"), ("none", "https://c.dev")], "package string, base string")
    symbols = spark.createDataFrame([("serde", "de::Value", 0), ("org.x:lib", "org.x.Box", 0), ("plain", "m.Client", 0), ("plain", "n.Client", 1), ("plain", "m.Client", 2), ("none", "x", 0)], "package string, symbol string, ord int")
    found = addresses.old_pages(packages, bases, symbols, 30)
    assert urls(found.where("package = 'serde'")) == ["https://docs.rs/serde/1.2.0/de_value.html", "https://docs.rs/serde/1.2.0/de/Value.html"]
    assert urls(found.where("package = 'org.x:lib'")) == ["https://javadoc.io/doc/org.x/lib/3.1/org/x/Box.html"]
    # By hand: every site, symbol and suffix in order, each address once.
    want = []
    for base in ("https://a.dev", "https://b.dev/docs"):
        for api in ("m.Client", "n.Client"):
            for suffix in addresses.PAGE_SUFFIXES:
                url = f"{base}/{suffix.format(v='2.0', api=api, slug='client', path=api.replace('.', '/'))}".rstrip("/")
                want += [url] if url not in want else []
    assert urls(found.where("package = 'plain'")) == want[:30]
    for limit in (1, 9, 10, 33, 500):
        assert urls(addresses.old_pages(packages, bases, symbols, limit).where("package = 'plain'")) == want[:limit]


def test_site_pages(spark):
    packages = spark.createDataFrame([("p",)], "package string")
    sites = spark.createDataFrame([("p", "https://a.dev/x", "https://a.dev"), ("p", "https://a.dev/y", "https://a.dev"), ("p", "https://b.dev", "https://b.dev"), ("z", "https://z.dev", "https://z.dev")], "package string, url string, base string")
    versions = spark.createDataFrame([("p", "2.0", 0), ("p", "3.0", 1)], "package string, version string, ord int")
    symbols = spark.createDataFrame([("p", "m.FetchAll", 0), ("p", "n.FetchAll", 1)], "package string, symbol string, ord int")
    suffixes = [*addresses.SITE_SUFFIXES, *(s.format(v=v) for v in ("2.0", "3.0") for s in addresses.VERSION_SUFFIXES), *(s.format(slug="fetch_all") for s in addresses.API_SUFFIXES)]
    want = []
    for url, base in (("https://a.dev/x", "https://a.dev"), ("https://a.dev/y", "https://a.dev"), ("https://b.dev", "https://b.dev")):
        for u in [url, *(f"{base}/{s}" for s in suffixes)]:
            want += [u.rstrip("/")] if u.rstrip("/") not in want else []
    for limit in (1, 5, 24, 26, 200):
        assert urls(addresses.site_pages(packages, sites, versions, symbols, limit)) == want[:limit]


def test_parse_cache(spark, tmp_path):
    seen = []

    def parse(files):
        seen.append({r["path"] for r in files.collect()})
        return files.select("path", F.explode(F.filter(F.split("content", " "), lambda w: w != "")).alias("word"))

    def refresh(rows, version=1):
        files = spark.createDataFrame(rows, "path string, mtime double, content string")
        return sorted(tuple(r) for r in parse_cache.refresh(files, f"{tmp_path}/cache", version, parse, 4).select("path", "word").collect())

    first = [(f"f{i}", 1.0, f"a{i} b") for i in range(9)] + [("blank", 1.0, "")]
    assert refresh(first) == sorted(x for i in range(9) for x in ((f"f{i}", f"a{i}"), (f"f{i}", "b"))) and len(seen[-1]) == 10
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    assert refresh(first) and seen[-1] == set()
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")} == before
    second = [("f0", 2.0, "new"), *first[2:]]
    assert refresh(second) == sorted([("f0", "new"), *(x for i in range(2, 9) for x in ((f"f{i}", f"a{i}"), (f"f{i}", "b")))]) and seen[-1] == {"f0"}
    assert refresh(first[2:4]) == sorted(x for i in (2, 3) for x in ((f"f{i}", f"a{i}"), (f"f{i}", "b"))) and seen[-1] == set()
    assert refresh(first[2:4], 2) and seen[-1] == {"f2", "f3"}
    assert refresh([]) == [] and refresh(first[:1]) == [("f0", "a0"), ("f0", "b")]


def test_packed_chunks(spark):
    rows = [("a", i, t) for i, t in enumerate(["x" * 10, "y" * 10, " ", "z" * 30, "w", "```", "code" * 10, "```", "end"])] + [("b", 0, None), ("c", 3, "late"), ("c", 1, "early")]
    df = spark.createDataFrame(rows, "key string, pos long, text string").repartition(3)
    found = {(r["key"], r["chunk"]): (r["first_pos"], r["last_pos"], r["content"]) for r in tables.packed_chunks(df, 25).collect()}
    assert found["a", 0] == (0, 1, "x" * 10 + "\n\n" + "y" * 10) and found["a", 1] == (3, 3, "z" * 30)
    assert found["a", 2] == (4, 7, "w\n\n```\n\n" + "code" * 10 + "\n\n```") and found["a", 3] == (8, 8, "end")
    assert found["c", 0] == (1, 3, "early\n\nlate") and len(found) == 5
    df.createOrReplaceTempView("paragraphs")
    lateral = spark.sql("SELECT count(*) AS n FROM packed_chunks(TABLE(SELECT key, pos, text FROM paragraphs WHERE key <> 'a'), 25)").first()
    assert lateral["n"] == 1
    with pytest.raises(Exception, match="key, pos and text"):
        spark.sql("SELECT * FROM packed_chunks(TABLE(SELECT 1 AS a), 25)").collect()


def test_texts_equal_their_sql_on_odd_input(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, "a&amp b&ampamp; c&amp;&lt;&lt;x&gt;"), (2, "<p>　é</p>&nbsp;\n\xa0&eacute;&#39;&#8217;&copy; <b>x</b> "), (3, "&amp;amp; &Amp;")], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    said = ["Called 100 times. 200.", "007 is 0", "1\n11 lines 1\n2", " \xa0a. b.　\n---\n***\n c! d? e.", "x\t\n\ty\x0b.  z", None, "---\r\r\nq"]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    for name, queries in (("q_html_to_text", driver_queries), ("q_purpose_sentences", project_queries)):
        for t in ("pages", "documents"):
            duck.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(duck.execute(queries.SQL[name]).fetchall())
