"""Mixing against its contract, and the splitting tree against drawing without replacement."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing

ROWS = "doc_id long, text string, source string, size int, target string, block long"


def corpus():
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(["a", "bb", "ccc", "é\tü", "x\ny"]) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 60)), rnd.choice(["s1", "s1", "s1", "s2", "Z", "é", None])) for i in range(300)]
    rows += [(900, None, "s1"), (901, "", "s1"), (902, " \n", None), (903, say(4000), "s2"), (904, "one word", "tiny"), (905, "", "empty"), (5, "again", "s1"), (5, "again", "s1"), (None, "no id", "s2")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], ROWS).repartition(3)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights, most):
    """Share again and again what is over the caps."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return share | {s: most * sizes[s] for s in capped}
        capped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    rows = corpus()
    return rows, mixing.mix(frame(spark, rows), block_words=64, shard_words=500).cache()


def test_targets_and_taken_words(mixed):
    rows, out = mixed
    found = out.collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in found) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets(sizes, (1, 2, 3), 3)
    taken = Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(d["words"] for d in r["draws"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6


def test_epochs_and_shards(mixed):
    rows, out = mixed
    by_source = defaultdict(list)
    for r in out.collect():
        by_source[r["source"]].append(r)
        assert len({d["epoch"] for d in r["draws"]}) == len(r["draws"])
    for own in by_source.values():
        size, taken = sum(r["size"] for r in own), sum(r["taken"] for r in own)
        whole = Counter(d["epoch"] for r in own for d in r["draws"] if d["words"] == r["size"])
        # All but the last epoch take all; at most one document is cut.
        assert sum(d["words"] != r["size"] for r in own for d in r["draws"]) <= 1
        for epoch in range(taken // size if size else 0):
            assert whole[epoch] == sum(r["size"] > 0 for r in own)
    shards = mixing.shard_rows(out).collect()
    places = defaultdict(list)
    for r in shards:
        places[r["shard"]].append(r["position"])
    assert len(places) > 4
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sum(r["words"] for r in shards) == sum(r["taken"] for own in by_source.values() for r in own)


def test_reruns_agree(spark, mixed):
    rows, out = mixed
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), block_words=64, shard_words=500)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["source"] or "", r["size"], r["taken"], str(r["draws"]))
    assert sorted(map(key, again.collect()), key=str) == sorted(map(key, out.collect()), key=str)


def test_empty_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    none = mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["target"], r["taken"]) for r in none] == [(0.0, 0)] * 2


def test_hypergeometric_numbers(spark):
    """Means and spreads of drawing without replacement, and its bounds."""
    cases = [(100, 30, 20), (10, 3, 9), (1000, 1, 500), (50, 50, 7), (50, 0, 7), (100_000, 40_000, 50_000), (7, 4, 7), (7, 4, 0)]
    rows = spark.createDataFrame(cases, "n long, k long, m long").crossJoin(spark.range(4000))
    chance = F.pmod(F.xxhash64("n", "k", "m", "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    found = rows.withColumn("x", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("m"), chance)).groupBy("n", "k", "m").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"))
    for r in found.collect():
        n, k, m = r["n"], r["k"], r["m"]
        sd = np.sqrt(m * k / n * (1 - k / n) * (n - m) / max(n - 1, 1))
        assert abs(r["mean"] - m * k / n) <= 5 * sd / np.sqrt(4000) + 1e-9
        assert abs(r["sd"] - sd) <= 0.1 * sd + 1e-9
        assert max(0, m + k - n) <= r["low"] <= r["high"] <= min(k, m)


@pytest.mark.parametrize("n_shards", [1, 13, 600])
def test_tree_keeps_quotas(spark, n_shards):
    quotas = [("a", False, 1000), ("b", False, 17), ("", True, 3), ("c", False, 0)]
    found = mixing.split_quotas(spark.createDataFrame(quotas, "source string, no_source boolean, quota long"), n_shards).collect()
    by_shard, by_source = Counter(), defaultdict(list)
    for r in found:
        by_shard[r["shard"]] += r["quota"]
        by_source[r["source"], r["no_source"]].append(r)
    assert {k: sum(r["quota"] for r in v) for k, v in by_source.items()} == {(s, z): q for s, z, q in quotas if q}
    assert max(by_shard.values()) - min(by_shard.values()) <= 2
    for own in by_source.values():
        at = 0
        for r in sorted(own, key=lambda r: r["shard"]):
            assert r["first"] == at
            at += r["quota"]
