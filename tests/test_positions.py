"""Phrases and distances from the positional index against a search of the texts."""

import random
import re

import pytest

from lodestone.operators import positions

PHRASES = ["ab", "a.b", "b c", "c", "use ", "@b", "b(", "b()", "é", "a.b.c", "xa", "no longer", "q" * 30]


def texts():
    rnd = random.Random(1)
    out = [None, "", "...", "a.b", ".a.b", "a.b.", "a.b.c", "xa.bx", "b()", "b( )", "@b", "@@b", "é éa aé", "use b", "no longer", "nono longerly", "q" * 90, "a..b a.b"]
    return out + ["".join(rnd.choice(["a", "b", "c", ".", " ", "ab", "é", "(", ")", "@", "no longer", "use "]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]


def found_in(text, phrase, how):
    side = {positions.ANYWHERE: ("", ""), positions.NAMES: (r"(?<![\w.])", r"(?![\w.])"), positions.WORDS: (r"(?<!\w)", r"(?!\w)")}[how]
    pattern = rf"(?={side[0]}({re.escape(phrase)}){side[1]})"
    return [m.start() for m in re.finditer(pattern, text or "")]


@pytest.mark.parametrize("how", [positions.ANYWHERE, positions.WORDS, positions.NAMES])
def test_phrase_places(spark, how):
    said = texts()
    index = positions.positional_index(spark.createDataFrame(list(enumerate(said)), "k int, t string"), "k", "t")
    wanted = [p for p in PHRASES if how == positions.ANYWHERE or re.match(r"\w.*\w$|\w$", p)]
    rows = positions.phrase_places(index, spark.createDataFrame([(p,) for p in (*wanted, wanted[0], "")], "phrase string"), how=how).collect()
    got = {(r["phrase"], r["key"], r["at"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {(p, i, at) for p in wanted for i, t in enumerate(said) for at in found_in(t, p, how)}
    for r in rows:
        text = said[r["key"]]
        assert text[r["at"] : r["end"]] == r["phrase"]
        assert (r["dots"], r["end_dots"]) == (text[: r["at"]].count("."), text[: r["end"]].count("."))


def test_near_pairs(spark):
    rnd = random.Random(2)
    left = [(rnd.choice("xxxy"), rnd.randint(0, 900), i) for i in range(150)]
    right = [(rnd.choice("xxxy"), rnd.randint(0, 900), i) for i in range(150)]
    a, b = spark.createDataFrame(left, "k string, at int, l int"), spark.createDataFrame(right, "k string, other int, r int")
    for low, high in ((-250, 400), (0, 0), (-20, -5), (3, 90)):
        want = {(x[2], y[2]) for x in left for y in right if x[0] == y[0] and low <= y[1] - x[1] <= high}
        rows = positions.near_pairs(a, b, ["k"], low, high).collect()
        assert len(rows) == len(want) and {(r["l"], r["r"]) for r in rows} == want
        assert {r["l"] for r in positions.has_near(a, b, ["k"], low, high).collect()} == {x for x, _ in want}
