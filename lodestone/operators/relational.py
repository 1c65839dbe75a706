"""Lookups, de-duplication, roll-ups and rankings, for any table and column names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.prefix import has_hot_key, prefix_sums
from lodestone.sources.storage import stored

#: Rows of the larger side that overlaps deals to a task, and rows of the smaller that they meet at a time.
OVERLAP_ROWS, OVERLAP_OTHERS = 4096, 512


def lookup_left(df: DataFrame, other: DataFrame, keys: Sequence[str], value: str, default: Column) -> DataFrame:
    """df with one column of other by a composite key; default where nothing matches."""
    found = other.select(*keys, F.col(value).alias("_found"))
    return df.join(found, list(keys), "left").withColumn(value, F.coalesce("_found", default)).drop("_found")


def resolve_by_precedence(candidates: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, value of the first candidate in order, those without a value left out. One aggregation, combined before
    the shuffle."""
    rows = candidates.where(F.col(value).isNotNull())
    return rows.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def default_else_last(df: DataFrame, key: str, value: str, order: Sequence[str], is_default: Column) -> DataFrame:
    """key, value of its first default row, else of its last row."""
    at = F.struct(*order)
    return df.groupBy(key).agg(F.coalesce(F.min_by(F.when(is_default, F.col(value)), F.when(is_default, at)), F.max_by(value, at)).alias(value))


def first_rows(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, by one min_by aggregation instead of a window over a possibly hot key."""
    names = df.columns
    row = F.struct(*(F.col(c) for c in names))
    keys = [(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(key)]
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*").select(*names)


def histogram(df: DataFrame, keys: Sequence[str], column: str, domain: Sequence[str]) -> DataFrame:
    """Rows of each value of a fixed domain as columns, zero-filled; other values count nowhere."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(column) == v).alias(v.lower()) for v in domain))


def check_status(failed: Column, skipped: Column) -> Column:
    """failed if any failed, skipped if all were skipped, else passed: an aggregate."""
    return F.when(F.bool_or(failed), "failed").when(F.bool_and(skipped), "skipped").otherwise("passed")


def best_of(column: Column, ranks: Sequence[str], default: str) -> Column:
    """The value of highest rank (the last of ranks is highest): an aggregate."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), column).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, ranks)), F.max(F.when(rank > 0, rank)) - 1), F.lit(default))


def review_state(decision: Column) -> Column:
    """Of hunks to their file: pending, accepted, rejected or partial: an aggregate."""
    return (
        F.when(F.bool_and(decision == "pending"), "pending")
        .when(F.bool_and(decision == "accepted"), "accepted")
        .when(F.bool_and(decision == "rejected"), "rejected")
        .otherwise("partial")
    )


def rank_cap_topk(df: DataFrame, group: str, order: Sequence[Column], cap: Column, k: int, most: int) -> DataFrame:
    """The best k rows with at most cap of a group. A row's cap may depend on the row, not only on its group.

    most: the largest cap; as a literal it lets Spark limit each group before the shuffle, hot groups too.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where((F.col("_rank") <= most) & (F.col("_rank") <= cap)).orderBy(*order).limit(k).drop("_rank")


def char_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str, budget: int, least_tail: int) -> DataFrame:
    """Rows until a running length reaches the budget, as column used; the last is cut if more than least_tail is left.

    Where a key has more rows than a window should hold, the running length goes by ranges of rows instead.
    """
    if has_hot_key(df, keys):
        measured = prefix_sums(stored(df, "budget-rows"), keys, order, {"_before": F.col(length)})
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        measured = df.withColumn("_before", F.coalesce(F.sum(length).over(w), F.lit(0)))
    left = F.lit(budget) - F.col("_before")
    rows = measured.where(F.col("_before") < budget)
    return rows.withColumn("used", F.least(F.col(length), left)).where((F.col(length) <= left) | (left > least_tail)).drop("_before")


def nested_budget(df: DataFrame, keys: Sequence[str], groups: Sequence[str], order: Sequence[str], length: str, group_budget: int, budget: int, least_tail: int) -> DataFrame:
    """Rows that are in the budget of their group and, of what is left of the groups in order, in that of their key."""
    inner = char_budget(df, [*keys, *groups], order, length, group_budget, least_tail)
    cut = inner.withColumn("_own", F.col("used")).drop("used")
    return char_budget(cut, keys, [*groups, *order], "_own", budget, least_tail).drop("_own")


def changed_rows(before: DataFrame, after: DataFrame, key: str, value: str, empty: Column) -> DataFrame:
    """key, before, after where they differ; a missing side is empty."""
    both = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full_outer")
    return both.select(key, F.coalesce("_b", empty).alias("before"), F.coalesce("_a", empty).alias("after")).where("before <> after")


def prefixes(column: Column, delimiter: str) -> Column:
    """All proper prefixes that end before a delimiter, as an array."""
    parts = F.split(column, F.concat(F.lit(r"\Q"), F.lit(delimiter), F.lit(r"\E")))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), delimiter))).otherwise(F.array().cast("array<string>"))


def prefer_specific(df: DataFrame, column: str, delimiters: Sequence[str]) -> DataFrame:
    """Distinct values that aren't, with a delimiter after them, the beginning of another: an equi anti-join on
    exploded prefixes."""
    values = df.select(column).distinct()
    shorter = None
    for d in delimiters:
        part = values.select(F.explode(prefixes(F.col(column), d)).alias(column))
        shorter = part if shorter is None else shorter.unionByName(part)
    return values.join(shorter.distinct(), column, "left_anti")


def allowed_by_prefix(df: DataFrame, column: str, allowed: DataFrame, delimiter: str) -> DataFrame:
    """Rows whose value, or a prefix of it, is in allowed (a column of the same name)."""
    values = df.select(column).distinct()
    every = values.select(F.col(column), F.explode(F.concat(prefixes(F.col(column), delimiter), F.array(F.col(column)))).alias("_prefix"))
    hit = every.join(allowed.select(F.col(column).alias("_prefix")).distinct(), "_prefix", "left_semi").select(column).distinct()
    return df.join(hit, column, "left_semi")


def ngram_weights(df: DataFrame, key: str, tokens: str, weights: Sequence[int] = (1, 2, 3), long_phrase: int = 8) -> DataFrame:
    """key, term, weight, size, first_pos: n-grams of an array of tokens; longer ones need over long_phrase characters."""
    parts = None
    for n, weight in enumerate(weights, 1):
        part = df.select(key, F.posexplode(_grams(F.col(tokens), n)).alias("pos", "term")).select(key, "term", "pos", F.lit(n).alias("size"), F.lit(weight).alias("w"))
        if n > 1:
            part = part.where(F.length("term") > long_phrase)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(key, "term").agg(F.sum("w").alias("weight"), F.min("size").alias("size"), F.min("pos").alias("first_pos"))


def _grams(words: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def top_terms(weighted: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The k heaviest terms; the longer first, then in order of appearance."""
    w = Window.partitionBy(key).orderBy(F.desc("weight"), F.desc(F.length("term")), "size", "first_pos", "term")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Words that one vectorised step of row_top_terms works on, or one row.
STEP_WORDS = 1 << 18


def best_terms(df: DataFrame, key: str, tokens: str, k: int = 20, weights: Sequence[int] = (1, 2, 3), long_phrase: int = 8) -> DataFrame:
    """What top_terms(ngram_weights(df)) gives, with rank: a key of one row has its n-grams counted inside the row, so
    only k rows of it leave the task; the n-grams of keys that have more rows are summed by key. df is read twice."""
    several = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col(key).alias("_several"))
    same = F.col(key).eqNullSafe(F.col("_several"))
    alone = row_top_terms(df.join(several, same, "left_anti"), key, tokens, k, weights, long_phrase)
    summed = top_terms(ngram_weights(df.join(several, same, "left_semi"), key, tokens, weights, long_phrase), key, k)
    return alone.unionByName(summed.select(*alone.columns))


def row_top_terms(df: DataFrame, key: str, tokens: str, k: int, weights: Sequence[int], long_phrase: int) -> DataFrame:
    """key, term, weight, rank: the k heaviest n-grams of each row's array of tokens, counted by sorting their numbers."""
    rows = df.select(F.col(key).alias("key"), F.col(tokens).alias("words"))
    out = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("rank", T.IntegerType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = batch.column("words")
        words = pc.fill_null(words, pa.scalar([], words.type))
        encoded = pc.list_flatten(words).dictionary_encode()
        number, spelled = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
        length = pc.utf8_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64)[number]
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.repeat(np.cumsum(counts), counts)
        row, place = np.repeat(np.arange(len(counts)), counts), np.arange(len(number))
        found, gram, said = [], number, length
        for n, weight in enumerate(weights, 1):
            if n > 1:
                # The number of a phrase is that of its beginning among all beginnings, and its last word's.
                if len(gram) < 2:
                    break
                _, begin = np.unique(gram[:-1], return_inverse=True)
                gram = begin * max(len(spelled), 1) + number[n - 1 :]
                said = said[:-1] + 1 + length[n - 1 :]
            fits = np.flatnonzero((place[: len(gram)] + n <= ends[: len(gram)]) & ((said > long_phrase) if n > 1 else True))
            order = fits[np.lexsort((gram[fits], row[fits]))]  # stable: places ascend
            new = np.ones(len(order), bool)
            new[1:] = (gram[order][1:] != gram[order][:-1]) | (row[order][1:] != row[order][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(order)))
            found.append(np.stack([row[order[first]], -weight * times, -said[order[first]], np.full(len(first), n), order[first]]))
        rank_row, load, long, size, at = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
        order = np.lexsort((at, size, long, load, rank_row))
        rank = np.arange(len(order)) - np.searchsorted(rank_row[order], rank_row[order])
        order, rank = order[rank < k], rank[rank < k]
        names = spelled.to_pylist()
        terms = [" ".join(names[number[j]] for j in range(a, a + n)) for a, n in zip(at[order], size[order], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rank_row[order])), pa.array(terms, pa.string()), pa.array(-load[order], pa.int64()), pa.array(rank + 1, pa.int32())], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP_WORDS, "right")))
                yield step(batch.slice(at, to - at))
                at = to

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def running_offset(df: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str) -> Column:
    """Sum of delta over the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(delta).over(w), F.lit(0))


_SEPARATORS = r"[^\p{L}\p{N}_]+"


def containments(df: DataFrame, key: str, text: str, terms: DataFrame, term_key: str, term: str, most_terms: int = 10_000, words: int = 4) -> DataFrame:
    """key, term_key of texts that contain a term (both in lower case).

    A term's words but its first and last are whole words of every text that contains it. So the first `words` of them
    find candidates by an equi-join with the texts' runs of words, and only candidates are searched for the term. Terms
    of two words or fewer have no such words; they are gathered in blocks of about most_terms, each one broadcast row
    of bounded size, and every text is searched for every block.
    """
    rows = df.select(key, F.lower(text).alias("_text"))
    wanted = terms.select(term_key, F.lower(term).alias("_term")).where("_term <> ''")
    split = F.split("_term", _SEPARATORS)
    inner = F.slice(F.slice(split, 2, F.greatest(F.lit(0), F.size(split) - 2)), 1, words)
    wanted = wanted.withColumn("_n", F.size(inner)).withColumn("_run", F.xxhash64(inner))
    long = wanted.where("_n > 0")
    sizes = sorted(r["_n"] for r in long.select("_n").distinct().collect())  # at most `words` numbers
    out = None
    if sizes:
        own = F.filter(F.split("_text", _SEPARATORS), lambda w: w != "")
        places = lambda n: F.when(F.size("_words") >= n, F.sequence(F.lit(1), F.size("_words") - n + 1)).otherwise(F.array().cast("array<int>"))
        hashed = lambda n: F.transform(places(n), lambda i: F.xxhash64(F.slice("_words", i, n)))
        runs = F.array_distinct(F.concat(*map(hashed, sizes)))
        found = rows.select(key, own.alias("_words")).select(key, F.explode(runs).alias("_run")).join(long.select(term_key, "_run"), "_run").select(key, term_key).distinct()
        out = found.join(rows, key).join(long.select(term_key, "_term"), term_key).where(F.contains("_text", F.col("_term"))).select(key, term_key)
    short = wanted.where("_n = 0")
    n_short = short.count()
    blocks = -(-n_short // most_terms)
    for i in range(blocks):
        part = short if blocks == 1 else short.where(F.pmod(F.xxhash64(term_key, "_term"), F.lit(blocks)) == i)
        packed = part.agg(F.collect_list(F.struct(term_key, "_term")).alias("_terms"))
        hits = rows.join(F.broadcast(packed), F.lit(True)).select(key, F.explode(F.filter("_terms", lambda t: F.contains(F.col("_text"), t["_term"]))).alias("t")).select(key, f"t.{term_key}")
        out = hits if out is None else out.unionByName(hits)
    return rows.join(wanted, F.lit(False)).select(key, term_key) if out is None else out


def overlaps(many: DataFrame, key: str, few: DataFrame, other: str, words: str, least: int) -> DataFrame:
    """key, other, shared: how many different words (arrays) two rows share, where at least so many.

    Rows of many are dealt by key, OVERLAP_ROWS of them a task, and meet OVERLAP_OTHERS of the few at a time, in a
    broadcast; so a pair is counted in the task that makes it, and no task holds more pairs however much there is.
    """
    spark = many.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(many.count() / OVERLAP_ROWS))
    dealt = many.select(key, words).repartition(parts, key).select(key, F.explode(words).alias("_word")).distinct()
    blocks = max(1, ceil(few.select(other).distinct().count() / OVERLAP_OTHERS))
    sides = few.select(other, F.explode(words).alias("_word")).distinct()
    found = None
    for b in range(blocks):
        block = sides.where(F.pmod(F.xxhash64(other), F.lit(blocks)) == b)
        counted = dealt.join(F.broadcast(block), "_word").groupBy(key, other).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
        found = counted if found is None else found.unionByName(counted)
    return found
