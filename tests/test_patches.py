"""The contract of patch responses on small blocks."""

from lodestone.operators import patches

BLOCK = "def f(x):\n    a = old(x, flag=True)\n    b = keep(a)\n    return b\n"
FILE = "from lib import old, keep, new\n\n" + BLOCK


def test_parse(spark):
    rows = [(1, 'say ```json\n{"schema_version": "1", "replacements": [{"start_line": 2, "end_line": 3, "replacement": "x"}]}\n```'), (2, "nothing"), (3, '{"status": "ok"}'), (4, '{"replacements": [{"start_line": 3, "end_line": 1, "replacement": "x"}]}'), (5, '{"replacements": [{"start_line": 1}]}')]
    found = {r["k"]: r for r in patches.parsed_replacements(spark.createDataFrame(rows, "k int, response string")).collect()}
    assert found[1]["parse_error"] is None and found[1]["replacements"][0]["end_line"] == 3
    assert [found[k]["parse_error"] for k in (2, 3, 4, 5)] == ["no JSON object", "no replacements", "malformed replacement", "malformed replacement"]


def test_blocks(spark):
    kind = "k int, replacements array<struct<start_line:int,end_line:int,replacement:string>>"
    rows = spark.createDataFrame([(1, [(1, 4, "x")]), (2, [(1, 3, "x"), (5, 9, "y"), (5, 9, "z")])], kind)
    blocks = spark.createDataFrame([(1, 1, 4), (2, 5, 9)], "k int, start_line int, end_line int")
    assert {r["k"]: r["errors"] for r in patches.matched_blocks(rows, blocks, "k").collect()} == {1: [], 2: ["lines 1-3 are no block", "lines 5-9 come 2 times"]}


def errors(replacement, documented=""):
    return patches.block_errors(BLOCK, replacement, [1], FILE, documented)


def test_validators(spark):
    good = BLOCK.replace("old(x, flag=True)", "new(x, mode='a')")
    assert errors(good, "pass mode to new") == []
    assert errors(good) == ["undocumented keyword of new: mode"]
    assert errors(BLOCK.replace("    b = keep(a)\n", "")) == ["unchanged line is missing: b = keep(a)"]
    assert errors(BLOCK.replace("old(x, flag=True)", "helper(x)")) == ["unresolved call: helper"]
    assert errors(BLOCK.replace("    a = old", "    import os\n    a = old")) == ["import inside a function"]
    assert errors(BLOCK.replace("return b", "return (b")) == ["unchanged line is missing: return b", "replacement does not parse"]
    rows = spark.createDataFrame([(BLOCK, good, [1], FILE, "mode"), (None, None, None, None, None)], "block string, replacement string, matched array<int>, file_source string, documented string")
    assert [r["errors"] for r in patches.validated(rows).collect()] == [[], []]


def test_pruning_and_splice(spark):
    source = "a = old(x, flag=True)\nb = old(flag=True, y=1)\nc = other(flag=True)\nd = old(é, flag=2)\n"
    assert patches.without_keywords(source, {"old"}, {"flag"}, {1, 2, 3}) == "a = old(x)\nb = old(y=1)\nc = other(flag=True)\nd = old(é, flag=2)\n"
    rows = spark.createDataFrame([(source, ["old"], ["flag"], [3])], "replacement string, calls array<string>, deprecated array<string>, matched array<int>")
    assert patches.pruned(rows).first()["replacement"].endswith("d = old(é)\n")
    files = spark.createDataFrame([("f", "1\n2\n3\n"), ("g", "x\n")], "file string, content string")
    accepted = spark.createDataFrame([("f", 3, 3, "three"), ("f", 1, 2, "one\ntwo\n")], "file string, start_line int, end_line int, replacement string")
    assert {tuple(r) for r in patches.patched_files(files, accepted).collect()} == {("f", "one\ntwo\nthree\n"), ("g", "x\n")}
