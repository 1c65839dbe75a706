"""The trie of prefixes against one built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lodestone.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth int, path string"


def conversations():
    rnd = random.Random(5)
    rows = []
    for c in range(260):
        n = rnd.choice([0, 1, 2, 3, 5, 9, 12])
        texts = [rnd.choice(["hi", "hi", "hi", "", "é", "what now"]) for _ in range(n)]
        if c % 3 == 0:
            texts = ["hi", "hello", "same", "end"]  # many copies
        rows += [(c, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)]
    rows += [(1000, None, None, None), (1000, 1, "user", "hi"), (1001, 0, "user", "x"), (1001, 0, "user", "x"), (1006, 0, "u", "seven"), (None, 0, "user", "lost"), (-3, 0, "user", "hi"), (2000, 0, "user", "w " * 40_000)]
    rows += [(3000, t, "user", "long") for t in range(300)]
    return rows


def brute(rows, group=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), said, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + turns[c][h:]
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += cost
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS).repartition(6)


@pytest.mark.parametrize(("last", "size", "piece"), [(4096, 1 << 20, 1 << 16), (30, 3000, 3)])
def test_trie(spark, monkeypatch, last, size, piece):
    for name, value in (("LAST", last), ("RANGE_BYTES", size), ("PIECE", piece)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations()
    found = prefix_trie.prefix_trie(frame(spark, rows)).collect()
    got = [tuple(r) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
    # 1006 % 5 is 1, its base 1005 is absent; what is left of it may be the root alone.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7)]
    assert {tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()} == brute(rows)


def test_merge_carries_lcps():
    rnd = random.Random(2)
    paths = sorted({b"".join(rnd.choice([b"a", b"b"]) * prefix_trie.TURN for _ in range(rnd.randint(0, 9))) for _ in range(400)})
    runs = [prefix_trie.Run() for _ in range(5)]
    for p in paths:
        run = rnd.choice(runs)
        run.lcps.append(prefix_trie.shared_turns(run.paths[-1], p) if run.paths else 0)
        run.paths.append(p)
        run.rows.append(len(p))
    out = list(prefix_trie.merged([*runs, prefix_trie.Run()]))
    assert [p for _, p, _ in out] == paths
    assert [lcp for lcp, _, _ in out][1:] == [prefix_trie.shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False)]
    assert all(r == len(p) for _, p, r in out)
