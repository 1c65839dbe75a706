"""A positional index of texts, phrases found in it by joins, and joins of positions by distance.

A row of the index is a word (a run of word characters) of a document with its place, its offset, and what stands
between it and the words beside it, so the text could be put together again. A phrase is cut the same way: its words
meet the index by equality, one join for all phrases and documents, and a phrase is found where all its words stand in
a row with its own separators between them. Parts of words are found in the vocabulary first, by equality with the
substrings of each different word, so no text is searched for any phrase.

Words are dealt by (word, part of the documents): a word that a third of all texts have lies in PARTS tasks, and a
document is nowhere gathered.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.storage import stored

#: Parts that the documents of one word are dealt into.
PARTS = 16
#: Size of the bitmap that leaves out words early: half a megabyte.
SIEVE_BITS = 22
#: How a phrase stands in a text: anywhere, parts of words too; as whole words; as whole words that no dot ties to others.
ANYWHERE, WORDS, NAMES = "anywhere", "words", "names"


def word_places(texts: DataFrame, key: str, text: str, sieve: bytes | None = None) -> DataFrame:
    """key, pos, at, word, before, after, last, dots for each word; dots: full stops before it. Null has no words.

    sieve: a bitmap of 2 ** SIEVE_BITS; words whose checksum it does not have are left out.
    """
    mask = (1 << SIEVE_BITS) - 1
    own = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("said"))
    fields = [T.StructField("key", own.schema["key"].dataType), T.StructField("pos", T.IntegerType()), T.StructField("at", T.IntegerType())]
    fields += [T.StructField(c, T.StringType()) for c in ("word", "before", "after")]
    fields += [T.StructField("last", T.BooleanType()), T.StructField("dots", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from itertools import accumulate, chain
        from operator import add
        from zlib import crc32

        class Sieved(dict):
            """Whether a word is wanted, remembered for words seen before."""

            def __missing__(self, w: str) -> bool:
                if len(self) >= 1 << 18:
                    self.clear()
                spot = crc32(w.encode()) & mask
                self[w] = found = bool(sieve[spot >> 3] >> (spot & 7) & 1)
                return found

        word, wanted = re.compile(r"\w+"), Sieved()
        for batch in batches:
            for i, said in enumerate(batch.column("said").to_pylist()):
                words = word.findall(said or "")
                kept = range(len(words)) if sieve is None else [j for j, w in enumerate(words) if wanted[w]]
                if not kept:
                    continue
                # What stands between the words; lengths give the offsets.
                gaps = word.split(said)
                at = list(accumulate(map(add, map(len, gaps), chain((0,), map(len, words)))))
                dots = list(accumulate(g.count(".") for g in gaps))
                n, end = len(kept), len(words) - 1
                columns = [
                    batch.column("key").slice(i, 1).take(pa.array([0] * n)), pa.array(kept, pa.int32()), pa.array([at[j] for j in kept], pa.int32()), pa.array([words[j] for j in kept], pa.string()),
                    pa.array([gaps[j] for j in kept], pa.string()), pa.array([gaps[j + 1] for j in kept], pa.string()), pa.array([j == end for j in kept], pa.bool_()), pa.array([dots[j] for j in kept], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "pos", "at", "word", "before", "after", "last", "dots"])

    return own.mapInArrow(run, T.StructType(fields))


def distinct_words(texts: DataFrame, text: str) -> DataFrame:
    """word: every word of the texts once; a batch's words are united before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"\w+")
        for batch in batches:
            found: set[str] = set()
            for said in batch.column("said").to_pylist():
                found.update(word.findall(said or ""))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["word"])

    return texts.select(F.col(text).cast("string").alias("said")).mapInArrow(run, "word string").distinct()


def word_sieve(words: DataFrame) -> bytes:
    """The bitmap of the checksums of a column word. It has a fixed size, whatever the number of words."""
    # Bitmaps count positions from 1, in buckets of 32768.
    spot = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(1 << SIEVE_BITS)) + 1
    maps = words.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    out = bytearray((1 << SIEVE_BITS) // 8)
    for row in maps.collect():
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


def positional_index(texts: DataFrame, key: str, text: str, phrases: DataFrame | None = None, how: str = ANYWHERE, buckets: int | None = None) -> DataFrame:
    """word_places and part, as a table bucketed by (word, part): a join with it does not shuffle it again.

    phrases (a column phrase): all that will be looked for in the index, and how; then words that are no part of any of
    them are left out where texts are read, but for a few that a sieve lets through. Where phrases stand for whole words
    the sieve is made of these, else of the texts' vocabulary, for which texts are read once more.
    """
    spark = texts.sparkSession
    buckets = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sieve = None
    if phrases is not None:
        parts = phrase_words(phrases, how)
        if how == ANYWHERE:
            vocabulary = stored(distinct_words(texts, text), "vocabulary")
            sieve = word_sieve(probes_in(vocabulary, parts).select("word"))
        else:
            sieve = word_sieve(parts.select(F.col("own").alias("word")))
    rows = word_places(texts, key, text, sieve).withColumn("part", F.pmod(F.hash("key"), F.lit(PARTS)))
    name = f"positions_{uuid.uuid4().hex}"
    rows.repartition(buckets, "word", "part").write.bucketBy(buckets, "word", "part").sortBy("word", "part").saveAsTable(name)
    return spark.table(name)


def phrase_words(phrases: DataFrame, how: str) -> DataFrame:
    """phrase, i, own, own_before, own_after, own_last, n, from_start, to_end: the words of phrases, stored; whether the word
    of a text that matches has to begin, or end, with it."""
    distinct = phrases.select("phrase").where("phrase <> ''").distinct()
    parts = word_places(distinct.withColumn("said", F.col("phrase")), "phrase", "said").select(
        F.col("key").alias("phrase"), F.col("pos").alias("i"), F.col("word").alias("own"), F.col("before").alias("own_before"), F.col("after").alias("own_after"), F.col("last").alias("own_last")
    )
    parts = stored(parts, "phrase-words")
    sizes = parts.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    whole = F.lit(how != ANYWHERE)
    return parts.join(sizes, "phrase").withColumn("from_start", whole | (F.col("i") > 0) | (F.col("own_before") != "")).withColumn("to_end", whole | ~F.col("own_last") | (F.col("own_after") != ""))


def probes_in(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """phrase_words with word and offset: the words of a vocabulary (column word) that a phrase's word matches, and where in them."""
    whole = vocabulary.join(parts.where("from_start AND to_end"), F.col("word") == F.col("own")).withColumn("offset", F.lit(0))
    loose = parts.where("NOT (from_start AND to_end)")
    # The lengths that substrings are made of; they are numbers below a phrase's length.
    lengths = sorted(r[0] for r in loose.select(F.length("own")).distinct().collect())
    if not lengths:
        return whole
    cut = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(0), F.length("word") - n), lambda o: F.struct(F.substring(F.col("word"), o + 1, F.lit(n)).alias("own"), o.alias("offset")))).otherwise(F.array().cast("array<struct<own:string,offset:int>>"))
    pieces = vocabulary.select("word", F.inline(F.concat(*map(cut, lengths))))
    fits = (~F.col("from_start") | (F.col("offset") == 0)) & (~F.col("to_end") | (F.col("offset") + F.length("own") == F.length("word")))
    return whole.unionByName(pieces.join(loose, "own").where(fits).select(*whole.columns))


def phrase_places(index: DataFrame, phrases: DataFrame, phrase: str = "phrase", how: str = ANYWHERE) -> DataFrame:
    """phrase, key, at, end, dots, end_dots: every place where a phrase stands in a text, overlapping ones too.

    A phrase without a word character is found nowhere. Texts and phrases should be normalised alike.
    """
    parts = phrase_words(phrases.select(F.col(phrase).alias("phrase")), how)
    opens, closes = F.col("i") == 0, F.col("own_last")
    # Where words have to be whole, they need no vocabulary.
    matches = parts.withColumn("word", F.col("own")).withColumn("offset", F.lit(0)) if how != ANYWHERE else probes_in(index.select("word").distinct(), parts)
    probes = matches.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    found = index.join(probes, ["word", "part"])
    length = F.length
    lead = F.when(opens, F.endswith("before", F.col("own_before"))).otherwise(F.col("before") == F.col("own_before"))
    trail = ~closes | F.startswith("after", F.col("own_after"))
    if how == ANYWHERE:
        found = found.where(lead & trail)
    else:
        ahead = F.substring(F.col("before"), F.lit(1), length("before") - length("own_before"))
        behind = F.substring(F.col("after"), length("own_after") + 1, length("after"))
        # A word stands at the edge of the text, or something is between it and the next one.
        clear = lambda rest, at_edge, side: ((rest == "") & at_edge) | ((rest != "") & (F.lit(True) if how == WORDS else side(rest, F.lit(1)) != "."))
        found = found.where(lead & trail & (~opens | clear(ahead, F.col("pos") == 0, F.right)) & (~closes | clear(behind, F.col("last"), F.left)))
    first = F.when(opens, F.col("at") + F.col("offset") - F.when(opens, length("own_before")).otherwise(0))
    end = F.when(closes, F.col("at") + F.col("offset") + length("own") + length("own_after"))
    stops = lambda c: length(c) - length(F.replace(F.col(c), F.lit("."), F.lit("")))
    rows = found.select("phrase", "key", "n", (F.col("pos") - F.col("i")).alias("start"), first.alias("at"), end.alias("end"), F.when(opens, F.col("dots") - stops("own_before")).alias("dots"), F.when(closes, F.col("dots") + stops("own_after")).alias("end_dots"))
    single = rows.where("n = 1").select("phrase", "key", "at", "end", "dots", "end_dots")
    several = rows.where("n > 1").groupBy("phrase", "key", "start").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"), *(F.max(c).alias(c) for c in ("at", "end", "dots", "end_dots"))).where("met = n")
    return single.unionByName(several.select("phrase", "key", "at", "end", "dots", "end_dots"))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], low: int, high: int, at: str = "at", other: str = "other") -> DataFrame:
    """left joined with right where keys are equal and low <= right.other - left.at <= high.

    Offsets are cut into bins as wide as the band; a row of left looks into the two bins that its band may reach, so
    a text of any length is many keys and a pair is found once.
    """
    width = high - low + 1
    bin_of = lambda c: F.floor(c / width).cast("long")
    looking = left.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col(at) + low), bin_of(F.col(at) + high)))))
    return looking.join(right.withColumn("_bin", bin_of(F.col(other))), [*keys, "_bin"]).where((F.col(other) - F.col(at)).between(low, high)).drop("_bin")


def has_near(left: DataFrame, right: DataFrame, keys: Sequence[str], low: int, high: int, at: str = "at", other: str = "other", also: Column | None = None) -> DataFrame:
    """The rows of left that near_pairs would find a partner for, once each."""
    width = high - low + 1
    bin_of = lambda c: F.floor(c / width).cast("long")
    narrow = right.withColumn("_bin", bin_of(F.col(other)))
    own = left.withColumn("_row", F.struct(*left.columns))
    looking = own.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(F.col(at) + low), bin_of(F.col(at) + high)))))
    extra = [c for c in narrow.columns if c not in (*keys, "_bin")]
    renamed = narrow.select(*keys, "_bin", *(F.col(c).alias(f"_{c}") for c in extra))
    near = (F.col(f"_{other}") - F.col(at)).between(low, high)
    return looking.join(renamed, [*keys, "_bin"]).where(near if also is None else near & also).select("_row").distinct().select("_row.*")
