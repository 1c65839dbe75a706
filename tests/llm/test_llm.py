"""The training-data operators against brute-force versions on small tables of awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import chat, components, decontamination, exact_dedup, language_id, line_dedup, near_dedup, packing, sharding, substring_dedup, textvec, toxicity

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOCS = "doc_id long, text string, recipe string, length int, node long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    """Texts with nulls, empties, copies, near copies, shared passages and one very long text."""
    rnd = random.Random(7)
    words = ["the", "of", "Ünï", "cat", "sat", "on", "mat", "12ab", "é", "x-y", "zeta", "Omega"] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = say(40), say(120)
    texts = [None, "", " \n\t", "one", "One", "a b c", "a b c", "A B C d", base, base, base + " end", base.replace(" of ", " OF ", 1)]
    texts += [say(rnd.randint(1, 80)) for _ in range(40)]
    texts += [say(10) + " " + passage + "\n" + say(12) for _ in range(6)] + [passage] * 3
    texts += [" ".join(w if rnd.random() > 0.02 else "zz" for w in base.split(" ")) for _ in range(8)]
    texts += [say(9000) + " " + passage, "q" * 70_000, "same\nsame\nsame"]
    return list(enumerate(texts))


def frame(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "r", 1, 5) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_words_and_hashes():
    texts = ["Hello  world\tA", None, "", " x", "éà Ünï 12ab-CD\nz", "w" * 200 + " q", "\x0b k"]
    for table, pattern, lower in ((textvec.NOT_SPACE, SPACE, False), (textvec.ALNUM, ALNUM, True)):
        words, seen = textvec.find_words(pa.array(texts), table, lower), {}
        hashes = words.hashes()
        for i, text in enumerate(texts):
            want = re.findall(pattern, low(text) if lower else text or "")
            span = range(words.first[i], words.first[i + 1])
            assert [words.text(j).decode() for j in span] == want
            assert textvec.joined_words(words, i).decode() == " ".join(want)
            for j in span:
                assert seen.setdefault(words.text(j), hashes[j]) == hashes[j]
        assert len(set(seen.values())) == len(seen)


# ---- 1 chat


def test_chat_round_trip(spark):
    turns = [
        (1, 2, "assistant", "b[NEXT]\\"), (1, 1, "user", "a</s>"), (1, 3, "assistant", ""), (1, 4, "assistant", "c"), (1, 5, None, None),
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "x]y", "[ROLE user]\n\\["), (None, 1, "user", "é" * 5000),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, said int")
    found = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    digest = by_id(chat.chat_digest(chat.format_chats(df)), "conv_id")
    for conv in {t[0] for t in turns}:
        own = [(r or "", x or "") for _, _, r, x in sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])]
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == own
        loss = "".join(x for r, x in own if r == "assistant")
        d = digest[conv]
        assert d["n_turns"] == len(own) and d["loss_chars"] == len(loss)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d["formatted_chars"] == len(found[conv]["formatted"])
    # Neighbours of one role share a block.
    assert found[1]["formatted"].count("[ROLE assistant]") == 1 and found[1]["formatted"].count("[/ROLE]") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_ties_repeats_and_length(spark):
    """Equal turn numbers go by role and text, repeated rows are turns, a long conversation is read back whole."""
    rows = [(1, 2, "user", "b"), (1, 2, "user", "b"), (1, 2, "assistant", "z"), (1, None, "user", "[NEXT]"), (1, 9, "user", None)]
    rows += [(2, i, "user" if i % 7 else "assistant", f"turn {i} [/ROLE] " + "x" * (i % 50)) for i in range(5000)]
    found = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.parse_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert found[1] == [("user", "[NEXT]"), ("assistant", "z"), ("user", "b"), ("user", "b"), ("user", "")]
    assert found[2] == [(r[2], r[3]) for r in rows if r[0] == 2]


# ---- 2 near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(SPACE, low(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_dedup(spark, docs, rows, k):
    want = brute_components(rows, k, 80)
    found = by_id(near_dedup.near_dedup(docs, shingle=k))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert len({c for _, c in want.values()}) < len(rows) - 10


def test_near_dedup_blocks(spark, monkeypatch):
    """A bucket of many blocks: a chain of near copies, each like its neighbours alone, and a star."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    rnd = random.Random(3)
    base = [f"a{i}" for i in range(200)]
    rows, text = [], list(base)
    for i in range(24):
        rows.append((i, " ".join(text)))
        text[rnd.randrange(200)] = f"n{i}"
        text[rnd.randrange(200)] = f"m{i}"
    rows += [(100 + i, " ".join(base[:150] + [f"s{i}_{j}" for j in range(6)])) for i in range(20)]
    found = by_id(near_dedup.near_dedup(frame(spark, rows), shingle=4))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(rows, 4, 80)


def test_near_dedup_in_buckets_of_many_blocks(spark, monkeypatch):
    """Pairs of near copies among many texts that share most of their bands, but no link: at least 0.9 are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    common = " ".join(f"c{i}" for i in range(90))
    tails = [" ".join(f"u{i}x{j}" for j in range(18)) for i in range(500)]
    rows = [(2 * i + k, f"{common} {tail}" + (f" v{i}" if k else "")) for i, tail in enumerate(tails) for k in (0, 1)]
    found = by_id(near_dedup.near_dedup(frame(spark, rows), 5, 80))
    assert sum(found[2 * i]["component_id"] == found[2 * i + 1]["component_id"] == 2 * i for i in range(500)) >= 450


def test_near_dedup_loses_no_link_between_blocks(spark, monkeypatch):
    """Every text in every bucket, and each bucket of many blocks: the links are still those of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "band_keys", lambda least: np.tile(np.arange(near_dedup.BANDS, dtype=np.uint64), (len(least), 1)))
    texts = [" ".join(f"u{i}x{j}" for j in range(40)) for i in range(60)]
    rows = [(2 * i + k, text + (f" v{i}" if k else "")) for i, text in enumerate(texts) for k in (0, 1)]
    found = by_id(near_dedup.near_dedup(frame(spark, rows), 5, 80))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == brute_components(rows, 5, 80)


def test_near_dedup_odd_rows(spark):
    found = near_dedup.near_dedup(frame(spark, [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "a b c d e"), (6, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in found) == [(-1, -1, True), (4, 4, True), (4, 4, True), (5, 4, False), (6, 6, True)]
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_b_bit_estimate():
    rng = np.random.default_rng(5)
    for j in (0.3, 0.8):
        errors = []
        for _ in range(60):
            n = 600
            shared = int(n * 2 * j / (1 + j))
            x = rng.integers(0, 1 << 63, n, np.int64).view(np.uint64)
            y = np.concatenate([x[:shared], rng.integers(0, 1 << 63, n - shared, np.int64).view(np.uint64)])
            one, two = near_dedup.pack(np.stack([near_dedup.minima(x * np.uint64(2)), near_dedup.minima(y * np.uint64(2))]))
            errors.append(near_dedup.similarity(near_dedup.matches(one, two[None, :])[0]) - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(70)] + [(300, 300 + i) for i in range(1, 40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)


# ---- 3 language


def sentences(lang, n, seed):
    rnd = random.Random(seed)
    stems = {"aa": ["kala", "moto", "rino", "tupa", "lemi", "saku"], "bb": ["schtorf", "gründ", "wölk", "krampf", "tzeit", "plünd"]}[lang]
    return [" ".join(rnd.choice(stems) + rnd.choice(stems)[:3] for _ in range(rnd.randint(3, 30))).capitalize() + "." for _ in range(n)]


def test_language_id(spark):
    rows = [(i, t, lang, "s") for lang, base in (("aa", 0), ("bb", 1000)) for i, t in enumerate(sentences(lang, 120, base), base)]
    schema = "doc_id long, text string, lang string, n string"
    model = language_id.train(spark.createDataFrame([*rows, (5000, None, "aa", ""), (5001, "kala", None, "")], schema))
    probe = [(1, sentences("aa", 1, 9)[0], "bb", ""), (2, sentences("bb", 1, 8)[0], None, ""), (3, None, "aa", ""), (4, "12 !!", "aa", ""), (5, "Жщфы цхъэ юяжщ", "aa", ""), (6, sentences("aa", 1, 7)[0] * 3000, "", ""), (None, sentences("aa", 1, 3)[0], "", "")]
    found = by_id(language_id.predict(spark.createDataFrame(probe, schema), model))
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 6)] == ["aa", "bb", "und", "und", "aa"]
    assert found[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == 7
    assert {i for i, r in found.items() if r["rejected"]} == {3, 4, 5}
    assert {r["doc_id"] for r in language_id.accepted(spark.createDataFrame(probe, schema), model).collect()} == {1, 2, 6, None}
    nothing = language_id.train(spark.createDataFrame([], schema))
    assert {r["lang_pred"] for r in language_id.predict(spark.createDataFrame(probe, schema), nothing).collect()} == {"und"}


@pytest.mark.parametrize("cells", [0, 400])
def test_language_id_is_the_same_where_the_grams_exceed_the_broadcast(spark, monkeypatch, cells):
    schema = "doc_id long, text string, lang string, n string"
    rows = [(i, t, lang, "s") for lang, base, n in (("aa", 0, 60), ("bb", 1000, 60)) for i, t in enumerate(sentences(lang, n, base), base)]
    rows += [(2000, "quixy", "cc", "s")]  # a rare language: all its grams are seen once
    probe = [(1, sentences("aa", 1, 9)[0], "", "p"), (2, sentences("bb", 1, 8)[0], None, None), (3, None, "aa", ""), (4, "12 !!", "aa", ""), (5, "Жщфы цхъэ юяжщ", "", ""), (6, "quixy", "", "q"), (6, "kala wölk", "", "r"), (None, "quixy moto", "", "")]
    docs, probes = spark.createDataFrame(rows, schema), spark.createDataFrame(probe, schema)
    whole = language_id.train(docs)
    monkeypatch.setattr(language_id, "MAX_CELLS", cells)
    parted = language_id.train(docs)
    assert len(parted.head.hashes) * 3 <= cells < whole.logs.size
    assert parted.limits == pytest.approx(whole.limits, abs=1e-5)
    a, b = (sorted(map(tuple, language_id.predict(probes, m).collect()), key=repr) for m in (whole, parted))
    assert len(a) == len(b) == len(probe)
    for x, y in zip(a, b, strict=True):
        assert (x[0], x[1], x[4]) == (y[0], y[1], y[4]) and x[2:4] == (pytest.approx(y[2], abs=1e-4), pytest.approx(y[3], abs=1e-5))
    a, b = (sorted(map(tuple, language_id.accepted(probes, m).collect()), key=repr) for m in (whole, parted))
    assert a == b and 0 < len(a) < len(probe)


def test_kneser_ney_sums_to_one():
    keys, _ = language_id.grams(pa.array(["the cat sat on the mat and the dog", "a dog and a cat"] * 3 + ["zebra"]))
    model = language_id.KneserNey(*np.unique(keys, return_counts=True), 0.6)
    for context in ("the", "xyz", " do"):
        base = int.from_bytes(context.encode("utf-16-be"), "big") << 16
        assert model.prob(np.uint64(base) | np.arange(1 << 16, dtype=np.uint64)).sum() == pytest.approx(1)


def test_kneser_ney_against_brute_force():
    """The recursion over sets of grams, written out, for the model's table and for grams never seen."""
    texts = ["the cat sat on the mat", "a cat and a dog", "the dog", "mat"]
    keys, _ = language_id.grams(pa.array(texts))
    grams = [tuple(int(k) >> s & 0xFFFF for s in (48, 32, 16, 0)) for k in keys]
    tops = {g: grams.count(g) for g in grams}
    orders = {4: tops}
    for n in (3, 2, 1):
        orders[n] = defaultdict(int)
        for g in orders[n + 1]:
            orders[n][g[1:]] += 1
    ratio = lambda c: min(0.95, max(0.1, sum(v == 1 for v in c.values()) / (sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values())))) if 1 in c.values() else 0.5
    discounts = {n: ratio(c) for n, c in orders.items()}

    def prob(gram):
        if not gram:
            return 1 / (1 << 16)
        counts, d = orders[len(gram)], discounts[len(gram)]
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not same:
            return prob(gram[1:])
        total = sum(same.values())
        return max(counts.get(gram, 0) - d, 0) / total + d * len(same) / total * prob(gram[1:])

    model = language_id.KneserNey(*np.unique(keys, return_counts=True), discounts[4])
    probes = [*tops, *(tuple(map(ord, w)) for w in ("the ", "zzzz", " cat", "xthe", "a mz"))]
    found = model.prob(np.array([a << 48 | b << 32 | c << 16 | d for a, b, c, d in probes], np.uint64))
    assert found == pytest.approx([prob(g) for g in probes])


def test_language_with_one_model_and_ties(spark):
    schema = "doc_id long, text string, lang string, n string"
    rows = [(i, t, lang, "") for lang in ("aa", "zz") for i, t in enumerate(sentences("aa", 20, 1))]
    probe = spark.createDataFrame([(1, "kala moto", "", ""), (1, "kala moto", "", ""), (2, "q", "", "")], schema)
    both = language_id.predict(probe, language_id.train(spark.createDataFrame(rows, schema))).collect()
    assert {r["lang_pred"] for r in both} == {"aa"} and {r["score"] for r in both} == {0.5} and len(both) == 3
    one = language_id.predict(probe, language_id.train(spark.createDataFrame(rows[:20], schema))).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("aa", 1.0)}


# ---- 4 exact duplicates


def check_exact(found, rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    for i, text in rows:
        own, r = groups[text or ""], found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), i == max(own))
        assert r["text_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_dedup(spark, docs, rows):
    check_exact(by_id(exact_dedup.exact_dedup(docs)), rows)
    # Fingerprints that collide all the time are never trusted.
    check_exact(by_id(exact_dedup.exact_dedup(docs, fingerprint=len)), rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    twice = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (None, "b"), (None, "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["group_size"], r["kept"]) for r in twice) == [(0, 1, True), (0, 3, False), (1, 3, True), (1, 3, True)]


def test_unique_rows_decide_by_row(spark):
    rows = [(5, "a b c"), (9, "a b c"), (5, "unique text here"), (1, "dup"), (1, "dup"), (None, "a b c"), (None, "alone"), (None, "alone"), (3, None), (4, "")]
    for options in ({}, {"fingerprint": len}):
        assert exact_dedup.recipes(frame(spark, rows), **options).count() == len(rows)
    kept = exact_dedup.unique_rows(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "recipe", "length", "node"]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(9, "a b c"), (5, "unique text here"), (1, "dup"), (None, "alone"), (4, "")], key=repr)
    assert exact_dedup.unique_rows(frame(spark, [])).count() == 0


def test_representatives_decide_by_row(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base), (5, base + " end"), (5, "another text altogether"), (None, base + " more"), (1, "dup"), (1, "dup"), (None, None), (2, ""), (None, "q r s t u v"), (None, "q r s t u v")]
    kept = near_dedup.representatives(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "recipe", "length", "node"]
    want = [(5, base + " end"), (5, "another text altogether"), (1, "dup"), (None, None), (2, ""), (None, "q r s t u v")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert near_dedup.representatives(frame(spark, [])).count() == 0


def test_chunk_ends_are_local():
    """An insertion changes the chunks around it alone."""
    rnd = random.Random(2)
    text = bytes(rnd.randrange(32, 127) for _ in range(60_000))

    def cut(b):
        data, off = textvec.utf8(pa.array([b], pa.binary()))
        ends = next(exact_dedup.chunk_ends(data, off))
        return [bytes(data[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    one, two = cut(text), cut(text[:30_000] + b"inserted" + text[30_000:])
    assert b"".join(one) == text and len(one) > 10 and len(set(one) & set(two)) >= len(one) - 4
    assert all(len(c) <= exact_dedup.MAX_CHUNK for c in cut(b"x" * 50_000))


# ---- 5 shards


def test_sharding(spark, docs, rows):
    found = by_id(sharding.byte_shards(docs, 7))
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    assert all(found[i]["size"] == size[i] and found[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t in rows)
    start, total = 0, sum(size.values())
    slots = defaultdict(int)
    for i in sorted(size):
        shard = min(6, (start + size[i] // 2) * 7 // total)
        assert (found[i]["shard"], found[i]["slot"], found[i]["law"], found[i]["grown_shard"]) == (shard, slots[shard], "bytes", None)
        start, slots[shard] = start + size[i], slots[shard] + 1
    assert sharding.byte_shards(frame(spark, []), 7).count() == 0
    same = sharding.byte_shards(frame(spark, [(1, "aa")] * 10 + [(None, None)] * 2), 3).collect()
    assert sorted((r["shard"], r["slot"]) for r in same) == [(s, i) for s in range(3) for i in range(4)]


# ---- 6 decontamination


def brute_hits(rows, items, window):
    pats = defaultdict(set)
    for item, text in items:
        w = re.findall(ALNUM, low(text))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            pats[tuple(w[j : j + window])].add(item)
    out = {}
    for i, text in rows:
        w, hit, own = re.findall(ALNUM, low(text)), set(), set()
        for m in {len(p) for p in pats}:
            for j in range(len(w) - m + 1):
                if (p := tuple(w[j : j + m])) in pats:
                    own |= pats[p] - {None}
                    hit |= set(range(j, j + m))
        out[i] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontamination, "PATTERN_BLOCK", block)
    long = next(t for _, t in rows if t and len(t) > 20_000 and " " in t).split(" ")
    items = [(1, " ".join(long[505:530])), (2, "the of"), (3, None), (4, "..."), (10, "A. b! C"), (11, " ".join(long[8000:8011]).upper()), (12, "nowhere to be found in here"), (12, "nowhere to be found in here"), (20, " ".join(long[505:530])), (None, " ".join(long[700:712]))]
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    found = by_id(decontamination.decontaminate(docs, items))
    want = brute_hits(rows, [(r["item_id"], r["text"]) for r in items.collect()], 10)
    assert {i: tuple(r)[1:] for i, r in found.items()} == want and any(v[4] for v in want.values())
    clean = decontamination.uncontaminated(docs, items)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, v in want.items() if not v[4]}
    assert not any(r["contaminated"] for r in decontamination.decontaminate(docs, items.limit(0)).collect())
    again = frame(spark, [(1, "the of x"), (1, "the of x"), (1, "y"), (None, "The OF"), (None, None)])
    found = decontamination.decontaminate(again, items).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in found) == [(0, 0, 0), (0, 2, 2), (1, 1, 0), (1, 3, 2), (1, 3, 2)]
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0


# ---- 7 packing


def test_tokens_and_packing(spark, docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), packing.WordTokens(path)
    rnd = random.Random(4)
    odd = ["".join(rnd.choice("aAbÉé́  \n\t'sST12½ΣσςİK<|endoftext|>,.!-‍😀中") for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["x<|endoftext|>y z", "a.<|startoftext|>", None]
    ids, off = own.encode(pa.array(odd))
    for i, text in enumerate(odd):
        assert ids[off[i] : off[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids
    capacity = 64
    packed = packing.pack_documents(docs, path, capacity).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        want = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = want[n * capacity : (n + 1) * capacity]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (n, n * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert len(pieces[i]) == -(-len(want) // capacity)
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    # As few as best-fit decreasing on one machine.
    gaps = []
    for length in sorted((r["length"] for r in packed), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps[gaps.index(fit)] -= length
    assert len(sequences) == len(gaps)
    assert packing.pack_documents(frame(spark, []), path, capacity).count() == 0
    assert sum(len(r["ids"]) for r in packing.packed_ids(docs.limit(20), path, capacity).collect()) > 0


@pytest.mark.parametrize("capacity, counts", [(64, {1: 500}), (64, {33: 7, 40: 2, 64: 3}), (100, {34: 50, 33: 49, 30: 7, 2: 11, 1: 3}), (4096, {n * 7: 1 + n % 5 for n in range(1, 200)})])
def test_best_fit_rounds(spark, capacity, counts):
    """Each piece gets one place, no place twice, no sequence overflows; as few sequences as best fit by decreasing length."""
    plan = packing.best_fit_rounds(spark.createDataFrame(list(counts.items()), "length long, n long"), capacity).collect()
    spans, ranks = defaultdict(list), defaultdict(set)
    for r in plan:
        for i in range(r["n"]):
            spans[r["first_seq"] + i // r["each"]].append((r["offset0"] + i % r["each"] * r["length"], r["length"]))
            assert r["lo"] + i not in ranks[r["length"]]
            ranks[r["length"]].add(r["lo"] + i)
    assert {length: set(range(n)) for length, n in counts.items()} == ranks
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            gaps.append(capacity - length)
        else:
            gaps[gaps.index(fit)] -= length
    assert len(spans) <= len(gaps) + 1 and set(spans) == set(range(len(spans)))


def test_packing_odd_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    found = packing.pack_documents(frame(spark, [(None, "a b"), (None, "a b"), (3, None), (3, None), (4, "")]), path, 64).collect()
    assert len(found) == 5 and len({r["sequence_id"] for r in found}) == 1 and len({r["offset"] for r in found}) == 5
    assert sorted(r["length"] for r in found if r["doc_id"] is not None) == [1, 1, 1]


# ---- 8 lines


def test_line_dedup(spark):
    rows = [(i, f"user {i} logged in at {i}:00 from home\nbody {i} of text number\nCopyright all rights reserved\n\n") for i in range(6)]
    rows += [(10, "something else entirely here\nCopyright all rights reserved"), (11, None), (12, ""), (13, "only once"), (14, "a b c " * 20_000)]
    found = by_id(line_dedup.drop_recurring_lines(frame(spark, rows), min_docs=5))
    assert [found[i]["n_dropped"] for i in (0, 10, 11, 12, 13, 14)] == [3, 1, 0, 0, 0, 0]
    assert found[0]["text"] == "\n" and found[0]["n_lines"] == 5
    assert found[10]["text"] == "something else entirely here" and found[11]["text"] is None and found[13]["text"] == "only once"
    assert line_dedup.drop_recurring_lines(frame(spark, [])).count() == 0


def test_line_dedup_is_linear_in_lines(spark):
    """A text of 100,000 lines, half of which go."""
    lines = [x for i in range(50_000) for x in ("the same line in all of them", f"own{i} word{i * 7} here{i * 3}")]
    rows = [(0, "\n".join(lines)), *((i, "the same line in all of them") for i in range(1, 6))]
    began = time.monotonic()
    found = by_id(line_dedup.drop_recurring_lines(frame(spark, rows), min_docs=5))
    assert time.monotonic() - began < 10
    assert found[0]["text"] == "\n".join(lines[1::2]) and found[0]["n_dropped"] == 50_000
    assert found[1]["text"] == "" and found[1]["n_lines"] == 1


def test_line_dedup_odd_rows(spark):
    """Repeated rows are one document; rows with null ids or shared ids are documents of their texts."""
    said = "All rights of this text reserved"
    copies = line_dedup.drop_recurring_lines(frame(spark, [(1, said)] * 9), min_docs=5).collect()
    assert [(r["n_dropped"], r["text"]) for r in copies] == [(0, said)] * 9
    several = [(None, f"x{i}q\n{said}") for i in range(3)] + [(4, f"y{i}q\n\t {said} ") for i in range(3)]
    found = line_dedup.drop_recurring_lines(frame(spark, several), min_docs=5).collect()
    assert sorted(r["text"] for r in found) == ["x0q", "x1q", "x2q", "y0q", "y1q", "y2q"] and {r["n_dropped"] for r in found} == {1}


# ---- 9 passages


def brute_kept(rows, window):
    first, words = {}, {}
    for i, text in sorted(rows):
        words[i] = w = re.findall(SPACE, text or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for p in range(j, j + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substring_dedup(spark, docs, rows, batches):
    found = by_id(substring_dedup.remove_repeats(docs, 13, batches))
    want = brute_kept(rows, 13)
    assert {i: tuple(r)[1:] for i, r in found.items()} == want and sum(v[1] for v in want.values()) > 500


def test_substring_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    found = substring_dedup.remove_repeats(frame(spark, [(None, text), (1, text), (2, text + " end"), (3, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in found) == [(0, 0), (1, 0), (2, 20), (3, 0)]
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


# ---- 10 toxicity


def test_toxicity(spark):
    rnd = random.Random(6)
    plain = [f"p{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1500):
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if bad := i % 6 == 0:
            w.insert(rnd.randrange(len(w)), rnd.choice(["grumblefoot", "Snarlface", "gitlump"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    extra = [(5000, None), (5001, ""), (5002, "p1 " * 50_000), (None, "p1")]
    marks = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    found = [r for r in toxicity.toxicity(frame(spark, rows + extra), marks, held).collect() if r["doc_id"] is not None]
    assert len(found) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert {r["doc_id"]: r["held_out"] for r in found}[7] == (zlib.crc32(b"7") % 4 == 2)
    tests = [r for r in found if r["held_out"] and r["doc_id"] < 1500]
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in tests]) > 0.97
    none = toxicity.toxicity(frame(spark, rows[:3]), marks.limit(0), held).collect()
    assert len(none) == 3 and not any(r["predicted"] for r in none)


def test_ftrl_against_brute_force():
    """The update of single coordinates, written out, over batches of examples."""
    rnd = random.Random(8)
    model = toxicity.Ftrl(bits=6, epochs=1)
    examples = [(sorted(rnd.sample(range(64), rnd.randint(0, 9))), rnd.random() < 0.4) for _ in range(75)]
    z, n = [0.0] * 65, [0.0] * 65
    weight = lambda i: 0.0 if (l1 := (0.0 if i == 64 else model.l1) * (1 + 0.5 * n[i] ** 0.5)) >= abs(z[i]) else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)
    for a in range(0, len(examples), toxicity.MINI_BATCH):
        own = examples[a : a + toxicity.MINI_BATCH]
        now = [weight(i) for i in range(65)]
        errors = [1 / (1 + np.exp(-(sum(now[i] for i in at) + now[64]))) - y for at, y in own]
        for i in range(65):
            met = [e for (at, _), e in zip(own, errors, strict=True) if i == 64 or i in at]
            if met:
                g2 = sum(e * e for e in met)
                z[i] += sum(met) - ((n[i] + g2) ** 0.5 - n[i] ** 0.5) / model.alpha * now[i]
                n[i] += g2
    own_z, own_n = np.zeros(65), np.zeros(65)
    flat, off = np.array([i for at, _ in examples for i in at]), np.cumsum([0, *(len(at) for at, _ in examples)])
    toxicity.ftrl_pass(model, own_z, own_n, flat, off, np.array([float(y) for _, y in examples]))
    assert own_z == pytest.approx(np.array(z)) and own_n == pytest.approx(np.array(n))
    assert model.weights(own_z, own_n) == pytest.approx([weight(i) for i in range(65)])


def test_toxicity_several_labels(spark):
    """Each label of a document is an example; columns of labels and documents that clash are not read."""
    from pyspark.sql import functions as F

    rows = [(i, "bad word" if i % 2 else "good word") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 2), "x") for i in range(200)] + [(1, 0, "x"), (1, 1, "x")], "doc_id long, toxic int, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame(spark, rows), labels, F.lit(False)).collect()}
    assert len(found) == 200 and found[3] > 0.5 > found[4]


# ---- the pipeline


def test_pipeline_loses_no_row(spark, tmp_path):
    """Repeated ids, repeated rows and null ids through the stages that drop copies, against brute force by row."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(5, "a b c d e f"), (9, "a b c d e f"), (5, "unique text here"), (1, "dup"), (1, "dup"), (None, "a b c d e f"), (6, "a b c d e f g")]
    rows += [(20 + i, t) for i, t in enumerate([" ".join(f"z{j}" for j in range(50)), " ".join(f"z{j}" for j in range(1, 50))])]
    exact = corpus_pipeline.exact(spark, frame(spark, rows), str(tmp_path))
    near = corpus_pipeline.near(spark, exact, str(tmp_path))
    best: dict = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert sorted((r["doc_id"], r["text"]) for r in exact.collect()) == sorted((i, t) for t, i in best.items())
    links = brute_components([(n, t) for n, (t, _) in enumerate(sorted(best.items(), key=lambda x: x[1]))], 5, 80)
    ordered = sorted(best.items(), key=lambda x: x[1])
    assert sorted((r["doc_id"], r["text"]) for r in near.collect()) == sorted((ordered[n][1], ordered[n][0]) for n, (_, c) in links.items() if n == c)
    assert near.columns == exact.columns == ["doc_id", "text", "recipe", "length", "node"]


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "aa", "s", len(t)) for i, t in enumerate(sentences("aa", 60, 1))] + [(100 + i, t, "bb", "s", len(t)) for i, t in enumerate(sentences("bb", 60, 2))]
    base = " ".join(t for t in sentences("aa", 4, 5))
    rows += [(200, base, "aa", "s", 1), (201, base, "aa", "s", 1), (202, base + " kala", "aa", "s", 1), (203, None, "aa", "s", 0), (204, "!!! 123", None, "s", 7)]
    leak = " ".join(sentences("bb", 3, 6))
    rows += [(205, sentences("bb", 1, 4)[0] + " " + leak, "bb", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontaminated", "packed"]
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
    every = {r[0] for r in rows}
    texts = {r[0]: r[1] for r in rows}
    largest = {t: i for i, t in sorted(texts.items()) for t in [t]}
    assert every - kept[0] == {203, 204}
    assert kept[1] == {i for i in kept[0] if largest[texts[i]] == i}
    want = brute_components([(i, texts[i]) for i in kept[1]], 5, 80)
    assert kept[2] == {i for i, (_, c) in want.items() if i == c}
    assert kept[3] == kept[2] - {205}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[3]
