"""Usage scan and evidence retrieval on small fixtures."""

import pytest

from lodestone.functions import text as tx
from lodestone.operators import evidence
from lodestone.sources import api_usage
from pyspark.sql import functions as F

SOURCES = {
    "a.py": ("python", "import acme as ac\nfrom acme.net import Client as C, get\n# acme.old.thing\nc = C(1)\nc.fetch('acme.str')\nd = c\nd.close()\nac.util.run()\nmine.append(1)\nget()\n"),
    "b.ts": ("typescript", "import def, { one as two } from 'acme/kit';\nimport * as all from 'acme';\ntwo.go(); def.run(); all.x.y();\nconst { z } = require('other');\n"),
    "c.rs": ("rust", "use acme::{net::{self, Client as C}, io::*};\nfn f() { let c = C::new(); net::open(); c.send(); }\n"),
    "d.go": ("go", 'import (\n\tk "acme/kit"\n\t"acme/net"\n)\nfunc f() { k.Run(); net.Open() }\n'),
    "e.java": ("java", "import acme.net.Client;\nclass A { Client c = new Client(); void f() { c.send(); Client.make(); } }\n"),
    "f.py": ("python", "x = 1\n"),
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(p, lang, c) for p, (lang, c) in SOURCES.items()] + [("g.bin", None, None)], "path string, language string, content string").cache()


def test_usages(spark, files):
    roots = spark.createDataFrame([("acme-kit", "acme"), ("zzz", "zzz")], "package string, root string")
    found = {r["usage"] for r in api_usage.find_usages(files, roots).where("package = 'acme-kit'").collect()}
    assert {"acme.net.Client", "acme.net.Client.fetch", "acme.net.Client.close", "acme.util.run", "acme.net.get", "acme.kit.one.go", "acme.kit.run", "acme.x.y", "acme.net.open", "acme.kit.Run", "acme.net.Open", "acme.net.Client.make"} <= found
    assert not any("append" in u or "old.thing" in u or u.startswith("other") for u in found)


def test_matches(spark, files):
    changes = spark.createDataFrame([("acme.net.Client.fetch",), ("acme.util.run",), ("acme.net.Client",), ("",)], "old_api string")
    found = {(r["file"], r["line"], r["col"], r["old_api"], r["matched_text"]) for r in api_usage.find_matches(files, changes).collect()}
    assert {("a.py", 5, 0, "acme.net.Client.fetch", "c.fetch"), ("a.py", 8, 0, "acme.util.run", "ac.util.run"), ("a.py", 4, 4, "acme.net.Client", "C")} <= found
    assert len({(f, line, c, a) for f, line, c, a, _ in found}) == len(found)


REFS = "ref_index int, source string, title string, url string, content string"


def test_chunks_and_ranking(spark):
    log = "# Release 2\n\nIntro text.\n\nClient.fetch was removed, use Client.get instead.\n\n```python\nc.fetch()\n\nc.get()\n```\n\n" + "\n\n".join(f"Filler paragraph {i} about nothing." for i in range(60))
    refs = spark.createDataFrame([(0, "web", "Release notes", "http://x/changelog", log), (1, "web", "Blog", "http://x/blog", "Client.fetch is nice."), (2, "web", "Release notes", "http://x/changelog", log)], REFS)
    chunked = evidence.chunks(refs, 200).cache()
    fenced = [r["content"] for r in chunked.where("ref_index = 0").collect() if "```" in r["content"]]
    assert len(fenced) == 1 and fenced[0].count("```") == 2 and "c.get()" in fenced[0]
    terms = evidence.search_terms(spark.createDataFrame([("acme.net.Client.fetch",)], "usage string"))
    assert {(r["term"], r["strong"]) for r in terms.collect()} == {("acme.net.client.fetch", True), ("client.fetch", True), ("net.client.fetch", True), ("fetch", False)}
    best = evidence.rank_chunks(evidence.score_chunks(chunked, terms, ["2.0"])).collect()
    assert len(best) == 1 and "removed" in best[0]["content"] and best[0]["document_kind"] == "release_notes" and best[0]["strong_terms"] == ["client.fetch"]
    fallback = evidence.fallback_chunks(chunked).collect()
    assert fallback and fallback[0]["evidence_confidence"] == "low" and "removed" in fallback[0]["content"]


def test_methods_and_meanings_pass_without_terms(spark):
    rows = [(0, "web", "Release notes", "http://x", "The client can fetch pages, but this is deprecated."), (1, "pypi", "acme", "http://pypi", "The client can fetch pages; use it."), (2, "web", "Notes", "http://y", "Pooled sockets are closed, which requires care."), (3, "web", "Notes", "http://z", "The client can fetch pages.")]
    chunked = evidence.chunks(spark.createDataFrame(rows, REFS))
    profiles = spark.createDataFrame([("client", "fetch")], "owner string, method string")
    terms = spark.createDataFrame([("zzz.none", True)], "term string, strong boolean")
    found = {r["ref_index"]: r for r in evidence.score_chunks(chunked, terms, (), profiles, ("pooled sockets", "closes pooled sockets")).collect()}
    assert set(found) == {0, 2}
    assert (found[0]["method_score"], found[0]["evidence_confidence"]) == (70, "medium") and found[0]["score"] == 70 + 3 + 6
    assert found[2]["semantic_score"] == 18 + 12


def test_kind_caps(spark):
    rows = [(i, "web", "Migration guide" if i < 9 else "Reference", "http://m" if i < 9 else "http://r", f"{i} Box.open was removed") for i in range(18)]
    terms = spark.createDataFrame([("box.open", True)], "term string, strong boolean")
    scored = evidence.score_chunks(evidence.chunks(spark.createDataFrame(rows, REFS)), terms)
    kinds = [r["document_kind"] for r in evidence.rank_chunks(scored).collect()]
    assert kinds.count("migration_guide") == 6 and len(kinds) == 8


def test_changelog_sections(spark):
    log = "# Changes\nold\n## 3.1.0\nthree one\n## v3.0.0\nthree\n## [2.5.0]\ntwo five\n## 2.0.0\ntwo\n## 1.9.0\none nine\n"
    docs = spark.createDataFrame([("d", log), ("e", "nothing here")], "doc string, content string")
    every = evidence.changelog_sections(docs, "2.4.0", "3.0.5").collect()
    assert [(r["content"], r["used"]) for r in every if r["doc"] == "e"] == [("nothing here", 12)]
    found = [(r["version"], r["content"]) for r in every if r["doc"] == "d"]
    assert [v for v, _ in found] == ["2.0.0", "3.0.0", "2.5.0"] and found[1][1] == "## v3.0.0\nthree"
    cut = evidence.changelog_sections(docs, "2.4.0", "3.0.5", budget=25, least_tail=5).collect()
    assert sum(r["used"] for r in cut if r["doc"] == "d") == 25
    rst = "Notes\n=====\n\nVersion 2.6\n-----------\nsix\n\n3.0.0 (2024)\n~~~~~~~~~~~~\nthree\n9.9.9\n~~\n"
    files = spark.createDataFrame([("r", rst, "a.RST"), ("m", rst, "a.md")], "doc string, content string, path string")
    found = evidence.changelog_sections(files, "2.4.0", "3.0.5").collect()
    assert [(r["version"], r["content"]) for r in found if r["doc"] == "r"] == [("3.0.0", "3.0.0 (2024)\n~~~~~~~~~~~~\nthree\n9.9.9\n~~\n"), ("2.6", "Version 2.6\n-----------\nsix\n")]
    assert [(r["version"], r["used"]) for r in found if r["doc"] == "m"] == [(None, len(rst))]


def test_rankable_and_flags(spark):
    rows = [(1, "Notes", "http://x/2.0/notes", None), (2, "Notes", "http://x/9.9/notes", ""), (3, "Old", "http://x", "old_api_docs"), (4, "Guide", "http://x/guide", None)]
    refs = spark.createDataFrame(rows, "ref_index int, title string, url string, role string")
    assert {r["ref_index"] for r in evidence.rankable(refs, "1.5.0", "2.5.0").collect()} == {1, 4}
    flags = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean").select(evidence.fallback_allowed(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in flags.collect()] == [True, False, True]


def test_doc_sections_and_names(spark):
    doc = "Intro\n  Parameters\n-----\na : int\n\nb : str\nReturns:\n---\nthe value\n# Next\nx"
    rows = spark.createDataFrame([(doc,), ("nothing",), (None,)], "t string")
    found = [tuple(r) for r in rows.select(tx.doc_section(F.col("t"), r"^(parameters?|args?)\b"), tx.doc_section(F.col("t"), r"^returns?\b"), tx.doc_section(F.col("t"), "^intro", 14)).collect()]
    assert found == [("a : int\n\nb : str", "the value", "Parameters\na :"), ("", "", ""), ("", "", "")]
    code = spark.createDataFrame([("self.x = fetch(b'it\\'s', len(y)) if z else \"no\"",)], "t string").select(tx.name_tokens(F.col("t")).alias("n"))
    assert code.first()["n"] == ["fetch", "x", "y", "z"]


def test_supported_changes(spark):
    changes = spark.createDataFrame(
        [("removed", "acme.Client.fetch", ""), ("renamed", "acme.Box", "acme::Box"), ("removed", "acme.other", ""), ("changed_signature", "acme.Client.connect", "x"), ("removed", "beta.thing.run", "")],
        "type string, old_api string, new_api string",
    )
    proofs = spark.createDataFrame(
        [("acme.Client", "`Client.fetch` was removed; use get instead"), ("acme.Client.connect.retry", "Use acme.Client.connect with the new setup"), ("acme.other", "it is deprecated"), ("beta", "beta.thing.run was removed, must migrate")],
        "api string, quote string",
    )
    nothing = spark.createDataFrame([], "api string")
    keep = lambda allowed: {r["old_api"] for r in evidence.supported_changes(changes, proofs, allowed).collect()}
    assert keep(nothing) == {"acme.Client.fetch", "acme.Client.connect", "beta.thing.run"}
    assert keep(spark.createDataFrame([("acme.Client",)], "api string")) == {"acme.Client.fetch", "acme.Client.connect"}


def test_supporting_references(spark):
    changes = spark.createDataFrame(
        [(1, "removed", "acme.Client.fetch", "acme.Client.get"), (2, "renamed", "acme.Box", "acme.kit.Container"), (3, "removed", "acme.lost", ""), (4, "", "acme.Pool.acquire_all", "acme.Pool.take_every")],
        "change_id int, type string, old_api string, new_api string",
    )
    docs = [
        (1, "web", "Blog", "http://b", "Client.fetch is nice, no news."),
        (2, "web", "Notes", "http://n", "Use care: `Client.fetch` needs a session, xClient.fetch too."),
        (3, "web", "Release notes", "http://r", "In 2.0 `Client.fetch` was removed; acme.Box moved, use Container()."),
        (4, "web", "Guide", "http://g", "You must call take_every now."),
        (5, "web", "Guide", "http://g5", "acquire_all is deprecated."),
    ]
    refs = spark.createDataFrame([(*d, float(d[0] == 4), ["package"], "high" if d[0] == 3 else None) for d in docs], "ref_index int, source string, title string, url string, content string, semantic_score double, matched_terms array<string>, evidence_confidence string")
    found = {r["change_id"]: r for r in evidence.supporting_references(changes, refs).collect()}
    # 1: the second speaks of use, but not of a removal. 4: meaning comes first, by the new name.
    assert {k: r["source_index"] for k, r in found.items()} == {1: 3, 2: 3, 4: 4}
    assert found[1]["confidence"] == "high" and found[4]["confidence"] == "medium" and found[4]["change_type"] == "migration_review"
    assert "Client.fetch` was removed" in found[1]["quote"] and found[1]["source"] == "release_notes"


def test_keywords_that_migrate(spark):
    from lodestone.operators import obligations

    texts = [
        "The `verify` argument was removed.", "verify=True is deprecated", "verify is fine. The option was removed", "reverify=1 was removed", "verify " + "x" * 500 + " argument removed", None, "",
        "param " + "y " * 20 + "verify" + " z" * 100 + " no longer there", "removed " + "w" * 260 + " verify = 1", "removed " + "w" * 230 + " verify = 1", "Verify =1. " + "k" * 300 + " renamed", "timeout keyword is required",
    ]
    evidence_rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words = spark.createDataFrame([("verify",), ("timeout",), ("Verify",), ("",)], "keyword string")
    found = {(r["doc_id"], r["keyword"]) for r in obligations.keyword_migrations(evidence_rows, words).collect()}
    assert found == {(0, "verify"), (1, "verify"), (7, "verify"), (9, "verify"), (10, "verify"), (11, "timeout")}
