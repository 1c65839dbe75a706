"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with Spark expressions only.

Targets: sources in order of their names weigh `weights`, repeating, and share as many words as there are; no target is
over `most` times its source's words, and what that leaves over is shared again by weight.

Blocks: a source's documents, in order of id, are cut where running sums pass a multiple of `block_words`, so a block
is a run of whole documents. An epoch draws a source's blocks in an order of its own, by hash. A source's quota is
exact: all blocks in each full epoch, and in the last one the first blocks of that epoch's order until the target is
reached; there one document is cut, so the words drawn of a source are its target, rounded.

Tree: how many drawn blocks of each source go to each output shard is found by halving ranges of shards. A node holds
its quotas by source; its left half gets a multivariate hypergeometric draw of them, one conditional hypergeometric
number for each source by inversion, the right half the rest. Only quotas move, whatever the size of the corpus. A
shard's share of a source is then the next run in the order of drawing, so shards are disjoint, and its documents are
shuffled inside it by hash.

Running sums go by ranges of rows (operators.prefix), so a source that has a third of all rows has many tasks. Blocks
meet their source's row through salted pairs. One row for each source (name, size, target) is sorted in one task, and a
node of the tree holds one number for each source.

Defined cases: null text has no words, and a document without words takes part with none; a null source is a source,
the last; documents that share an id are ordered by size and digest, repeated rows are documents of their own; null
ids come first; an empty table, or one without words, gives targets of 0 and draws nothing. Only the id, source and
text columns are read.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import bound
from lodestone.llm.common import materialize, spread_join
from lodestone.operators.prefix import prefix_sums

#: Draws that one key of the join of drawn blocks with shards covers.
BIN = 64
#: Standard deviations on either side of the mean that a hypergeometric number is looked for in; what lies outside has a chance below 1e-20.
REACH = 10
_SOURCE = ["source", "no_source"]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, no_source, source_size and target for rows of source, no_source, source_size."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "source")))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    weighed = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    # Sources reach their cap in order of cap to weight: one does where its share of what those before it leave is more.
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    spent, left = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    told = weighed.withColumn("total", F.sum("source_size").over(everything)).withColumn("spent", spent).withColumn("left", left)
    capped = told.withColumn("capped", (F.col("total") - F.col("spent")).cast("double") * F.col("weight") > F.col("cap").cast("double") * F.col("left"))
    free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    kept = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    share = (F.col("weight") * kept).cast("double") / free
    return capped.select(*_SOURCE, "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, chance: Column) -> Column:
    """Of `draws` from `total` things without replacement, the number that are among the `good` ones; chance is uniform in [0, 1)."""

    def of(x: Column) -> Column:
        n, k, m = x["n"], x["k"], x["m"]
        least, most = F.greatest(F.lit(0), m - (n - k)), F.least(k, m)
        share = k / F.greatest(n, F.lit(1))
        sd = F.sqrt(m * share * (1 - share) * (n - m) / F.greatest(n - 1, F.lit(1)))
        low = F.greatest(least, F.floor(m * share - REACH * sd - REACH))
        high = F.least(most, F.ceil(m * share + REACH * sd + REACH))
        return bound(F.struct(n.alias("n"), k.alias("k"), m.alias("m"), low.cast("long").alias("low"), high.cast("long").alias("high"), x["u"].alias("u")), walk)

    def walk(x: Column) -> Column:
        steps = F.when(x["high"] > x["low"], F.sequence(x["low"], x["high"] - 1)).otherwise(F.array().cast("array<bigint>"))
        # How likely i + 1 is, against i.
        odds = lambda i: ((x["k"] - i) * (x["m"] - i)).cast("double") / ((i + 1) * (x["n"] - x["k"] - x["m"] + i + 1)).cast("double")
        state = lambda p, said, at: F.struct(p.alias("p"), said.alias("said"), at.alias("at"))
        begin = state(F.lit(1.0), F.lit(1.0), x["low"])
        onward = lambda s, i: bound(s["p"] * odds(i), lambda p: state(p, s["said"] + p, s["at"]))
        whole = F.aggregate(steps, begin, onward, lambda s: s["said"])
        until = lambda wanted: F.aggregate(steps, begin, lambda s, i: bound(s["p"] * odds(i), lambda p: state(p, s["said"] + p, F.when(s["said"] <= wanted, i + 1).otherwise(s["at"]))), lambda s: s["at"])
        return bound(whole * x["u"], until)

    long = lambda c: c.cast("long")
    return bound(F.struct(long(total).alias("n"), long(good).alias("k"), long(draws).alias("m"), chance.alias("u")), of)


def split_quotas(quotas: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """source, no_source, shard, first, quota: the quotas of sources (rows of source, no_source, quota) dealt to shards.

    Each shard's total is that of its equal share, rounded; first is the number of the source's draws in earlier shards.
    """
    spark = quotas.sparkSession
    told = F.sort_array(F.collect_list(F.struct("no_source", "source", "quota")))
    root = quotas.groupBy().agg(told.alias("told")).where(F.size("told") > 0)
    nodes = root.select(F.lit(0).cast("long").alias("low"), F.lit(n_shards).cast("long").alias("high"), F.transform("told", lambda q: F.struct(q["no_source"].alias("no_source"), q["source"].alias("source"))).alias("names"), F.transform("told", lambda q: q["quota"].cast("long")).alias("quotas"))
    for level in range(math.ceil(math.log2(max(n_shards, 1)))):
        if level and level % 8 == 0:
            # Nodes are many by now: deal them out.
            nodes = materialize(nodes.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "low"), "mix-nodes")
        middle = F.expr("(low + high) div 2")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        drawn = bound(
            F.struct(total.alias("n"), (middle - F.col("low")).alias("mine"), (F.col("high") - F.col("low")).alias("all")),
            lambda x: bound(F.struct(x["n"].alias("n"), F.floor(x["n"].cast("decimal(38,0)") * x["mine"] / x["all"]).cast("long").alias("m")), lambda y: _left_quotas(y["n"], y["m"], seed)),
        )
        halved = nodes.withColumn("left", F.when(F.col("high") - F.col("low") > 1, drawn))
        low_half = F.struct(F.col("low").alias("low"), middle.alias("high"), F.col("left").alias("quotas"))
        high_half = F.struct(middle.alias("low"), F.col("high").alias("high"), F.zip_with("quotas", "left", lambda q, a: q - a).alias("quotas"))
        same = F.struct("low", "high", "quotas")
        halves = F.when(F.col("left").isNull(), F.array(same)).otherwise(F.array(low_half, high_half))
        nodes = halved.select("names", F.explode(halves).alias("node")).select("node.low", "node.high", "names", "node.quotas")
    leaves = nodes.select(F.col("low").alias("shard"), F.explode(F.arrays_zip("names", "quotas")).alias("own")).select("own.names.source", "own.names.no_source", "shard", F.col("own.quotas").alias("quota"))
    leaves = materialize(leaves, "mix-leaves")
    return prefix_sums(leaves, _SOURCE, ["shard"], {"first": F.col("quota")}).where(F.col("quota") > 0)


def _left_quotas(total: Column, draws: Column, seed: int) -> Column:
    """What the left half gets of each quota: the sources one after another, each of what the earlier ones left."""
    state = lambda n, m, given: F.struct(n.alias("n"), m.alias("m"), given.alias("given"))
    chance = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("low"), F.col("high"), i), F.lit(1 << 53)) / F.lit(float(1 << 53))
    give = lambda s, q: bound(hypergeometric(s["n"], q["q"], s["m"], chance(q["i"])), lambda x: state(s["n"] - q["q"], s["m"] - x, F.concat(s["given"], F.array(x))))
    numbered = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    return F.aggregate(numbered, state(total, draws, F.array().cast("array<bigint>")), give, lambda s: s["given"])


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 4096, shard_words: int = 1 << 20, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, draws (epoch, shard, words: the document's first words that are taken) for each document."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(source, F.lit("")).alias("source"),
        source.isNull().alias("no_source"),
        F.coalesce(word_count(F.col(text_col).cast("string")), F.lit(0)).alias("size"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )
    rows = materialize(rows, "mix-rows")
    targets = source_targets(rows.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size")), weights, most)
    # A document counts one more than its words, so that those without words do not pile up in a block.
    summed = prefix_sums(rows, _SOURCE, ["doc_id", "size", "digest"], {"start": F.col("size"), "place": F.col("size") + 1})
    placed = materialize(summed.select("doc_id", *_SOURCE, "size", "start", F.expr(f"place div {block_words}").alias("block")), "mix-placed")
    blocks = placed.groupBy(*_SOURCE, "block").agg(F.sum("size").alias("words"), F.min("start").alias("begins"))
    blocks = materialize(blocks, "mix-blocks")
    n_blocks = blocks.where("words > 0").groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("n_blocks"))
    aimed = materialize(targets.join(n_blocks, _SOURCE, "left").withColumn("wanted", F.floor(F.col("target") + 0.5)), "mix-targets")
    blocks = materialize(spread_join(blocks, aimed, _SOURCE, F.xxhash64("block")), "mix-aimed")

    epochs = F.sequence(F.lit(0).cast("long"), F.expr("(wanted - 1) div source_size"))
    drawing = blocks.where("words > 0 AND wanted > 0").select("*", F.explode(epochs).alias("epoch"))
    order = F.md5(F.concat_ws(":", F.lit(seed), "epoch", "source", "block").cast("binary"))
    drawing = drawing.select(*_SOURCE, "block", "epoch", "words", "n_blocks", (F.col("wanted") - F.col("epoch") * F.col("source_size")).alias("rest"), order.alias("order"))
    drawn = prefix_sums(materialize(drawing, "mix-drawing"), [*_SOURCE, "epoch"], ["order", "block"], {"before": F.col("words"), "rank": F.lit(1)}).where("before < rest")
    drawn = materialize(drawn.select(*_SOURCE, "block", "epoch", F.least("words", F.col("rest") - F.col("before")).alias("given"), (F.col("epoch") * F.col("n_blocks") + F.col("rank")).alias("draw")), "mix-drawn")

    total = drawn.agg(F.sum("given")).first()[0] or 0
    shards = split_quotas(drawn.groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("quota")), max(1, -(-total // shard_words)), seed)
    shards = shards.select(*_SOURCE, "shard", "first", (F.col("first") + F.col("quota")).alias("last"), F.explode(F.expr(f"sequence(first div {BIN}, (first + quota - 1) div {BIN})")).alias("bin"))
    sharded = drawn.withColumn("bin", F.expr(f"draw div {BIN}")).join(shards, [*_SOURCE, "bin"]).where("draw >= first AND draw < last")
    # A block has at most one draw an epoch.
    draws = sharded.groupBy(*_SOURCE, "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "given"))).alias("drawn"))
    known = blocks.join(draws, [*_SOURCE, "block"], "left").select(*_SOURCE, "block", "begins", "source_size", "target", "drawn")

    own = F.transform("drawn", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.least(F.col("size"), F.greatest(F.lit(0), d["given"] - (F.col("start") - F.col("begins")))).alias("words")))
    mixed = placed.join(known, [*_SOURCE, "block"]).withColumn("draws", F.coalesce(F.filter(own, lambda d: d["words"] > 0), F.array().cast("array<struct<epoch:bigint,shard:bigint,words:bigint>>")))
    return mixed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws",
    )


def shard_rows(mixed: DataFrame, seed: int = 0) -> DataFrame:
    """shard, position, doc_id, source, epoch, words: what mix draws, shuffled inside each shard."""
    rows = mixed.select("doc_id", "source", "size", F.explode("draws").alias("draw")).select("draw.shard", "doc_id", "source", "size", "draw.epoch", "draw.words")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "epoch", "doc_id", "size"), "doc_id", "epoch", "size")
    return rows.select("shard", (F.row_number().over(order) - 1).cast("long").alias("position"), "doc_id", "source", "epoch", "words")
