"""Reviews, checks, providers and reference candidates on small tables."""

from lodestone.operators import diff, references, review
from pyspark.sql import functions as F

TEXT = "\n".join(f"line {i}" for i in range(30)) + "\n"
PATCHED = TEXT.replace("line 3\n", "LINE 3\nextra\n").replace("line 25\n", "")


def test_decisions(spark):
    files = spark.createDataFrame([("s", f, TEXT, PATCHED) for f in ("a", "b", "c", "d")], "session_id string, relative_path string, original string, patched string")
    hunks = files.select("session_id", "relative_path", F.explode(diff.hunks("original", "patched")).alias("h")).select("session_id", "relative_path", "h.hunk_id", "h.old_start", "h.old_lines", "h.new_lines")
    said = [("s", "a", "hunk_001", "accepted"), ("s", "a", "hunk_002", "accepted"), ("s", "b", "hunk_001", "accepted"), ("s", "b", "hunk_002", "rejected"), ("s", "c", "hunk_001", "rejected"), ("s", "c", "hunk_002", "rejected")]
    decided = review.file_decisions(hunks, spark.createDataFrame(said, "session_id string, relative_path string, hunk_id string, decision string"))
    found = {r["relative_path"]: (r["state"], r["final_content"]) for r in review.apply_decisions(files, decided).collect()}
    assert found == {"a": ("accepted", PATCHED), "b": ("partial", TEXT.replace("line 3\n", "LINE 3\nextra\n")), "c": ("rejected", TEXT), "d": ("pending", TEXT)}
    assert review.review_totals(decided).first().asDict() == {"pending": 1, "accepted": 1, "rejected": 1, "partial": 1}
    gaps = {(r["old_line"], r["new_line"]) for r in review.gap_lines(hunks.where("relative_path = 'a'")).where("hunk_id = 'hunk_002'").collect()}
    assert gaps == {(i, i + 1) for i in range(8, 23)}


def test_sessions_and_overlay(spark):
    rows = [("f", 1, TEXT, TEXT.replace("line 2\n", "two\n")), ("f", 2, TEXT, TEXT.replace("line 20\n", "twenty\n")), ("g", 1, "a\n", "b\n")]
    found = {r["relative_path"]: (r["content"], r["sessions"]) for r in review.merge_sessions(spark.createDataFrame(rows, "relative_path string, ord int, original string, patched string")).collect()}
    assert found == {"f": (TEXT.replace("line 2\n", "two\n").replace("line 20\n", "twenty\n"), 2), "g": ("b\n", 1)}
    base, over = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string"), spark.createDataFrame([("b", "3"), ("c", "4")], "path string, content string")
    assert {tuple(r) for r in review.overlay(base, over).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}


def test_checks_and_providers(spark):
    files = spark.createDataFrame([("package.json",), ("requirements.txt",), ("setup.py",), ("x/Cargo.toml",)], "path string")
    assert [(r["command"], r["available"]) for r in review.detected_checks(spark, files, ["python"]).collect()] == [("npm run build", False), ("python -m compileall", True)]
    results = spark.createDataFrame([("passed",), ("timeout",)], "status string")
    assert review.check_summary(results).first()["status"] == "failed" and review.check_summary(results.limit(0)).first()["status"] == "skipped"
    providers = spark.createDataFrame([("a", True, 3), ("b", False, 1), ("c", True, 2), ("d", True, 1)], "name string, enabled boolean, priority int")
    assert [r["name"] for r in review.provider_order(providers, ["c", "b"]).orderBy("priority").collect()] == ["c", "d", "a"]
    rows = spark.createDataFrame([("x.py", "a\nb\n", [(1, 1, "z"), (9, 9, "q")])], "file string, content string, replacements array<struct<start_line:int,end_line:int,replacement:string>>")
    assert tuple(review.repaired(rows).first()) == ("x.py", "z\nb\n", "partial")
    bad = review.syntax_errors(spark.createDataFrame([("a.py", "x ="), ("b.py", "x = 1"), ("c.js", "x =")], "path string, content string"))
    assert [r["path"] for r in bad.collect()] == ["a.py"]


def test_candidates(spark):
    packages = spark.createDataFrame([("acme", "1.2.0", "2.0.0")], "name string, current string, latest string")
    symbols = spark.createDataFrame([("acme", "acme.HTTPClient"), ("acme", "acme.HTTPClient")], "name string, symbol string")
    paths = [r["path"] for r in references.candidate_paths(packages, symbols).orderBy("ord").collect()]
    assert paths[0] == "CHANGELOG.md" and "docs/releases/2.0.0.md" in paths and "docs/api/httpclient.md" in paths and len(paths) == len(set(paths))
    files = spark.createDataFrame([("docs/migration/v2.0.md",), ("src/a.py",), ("docs/intro.md",), ("CHANGELOG.md",), ("pic.md",)], "path string")
    fetched = spark.createDataFrame([("CHANGELOG.md",)], "path string")
    best = references.tree_documents(files, fetched, F.array(F.lit("client")), F.array(F.lit("2.0"))).collect()
    assert [(r["path"], r["path_score"]) for r in best] == [("docs/migration/v2.0.md", 78), ("docs/intro.md", 5)]
    index = spark.createDataFrame([("u", "Title\n\n  changes/1.9.rst\n  changes/2.1.rst\n  changes/2.0.1.rst\n* skip 2.2\nhttp://x/2.3\n")], "url string, content string")
    assert [r["path"] for r in references.linked_changelogs(index, "2.0.0", "2.5.0").collect()] == ["changes/2.1.rst", "changes/2.0.1.rst"]


def test_pages_and_notes(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(references.is_not_found(F.lit("<h1>Page Not Found</h1>"), F.lit("http://x"))) and not one(references.is_not_found(F.lit("fine"), F.lit("http://x")))
    assert one(references.is_docs_like(F.lit("https://docs.acme.io/x"))) and not one(references.is_docs_like(F.lit("https://github.com/a/docs")))
    assert one(references.docs_base(F.lit("https://acme.io/en/latest/x"))) == "https://acme.io/en" and one(references.docs_base(F.lit("https://acme.io/path/x"))) == "https://acme.io"
    releases = spark.createDataFrame([("a", 0, "v3.1", "x"), ("a", 1, "2.0.0", None), ("a", 2, "1.9", "old"), ("a", 3, "1.8", "older")], "name string, ord int, tag string, body string")
    assert references.release_notes(releases, "2.4.0").first()["content"] == "## Version v3.1\nx\n\n## Version 2.0.0\n\n\n## Version 1.9\nold"
    part = lambda *rows: spark.createDataFrame(rows, "source string, title string, url string, content string, ord int")
    joined = references.assemble([part(("s", "t", "u", "second", 1), ("s", "t0", "u", "first", 0)), part(("s", "t", "u", "late", 0), ("r", "t", "u", "third", 1))]).collect()
    assert [(r["ref_index"], r["content"]) for r in joined] == [(0, "first"), (1, "second"), (2, "third")]
    assert references.registry_reference(spark, "npm", "x").first()["url"].endswith("/package/x")
