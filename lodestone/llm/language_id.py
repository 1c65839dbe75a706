"""Language identification with interpolated Kneser-Ney character models.

One 4-gram model for each language, counted over all training rows: the words' letters in lower case, any run of
other characters as one space. Counting gives each language's 4-grams; lower orders follow from them by continuation
counts, as Kneser-Ney has it. The log probabilities of all known 4-grams lie in one table, sorted by hash, with a column
for each language; a few passes over a prefix directory find a gram. Unknown grams back off through the lower orders.
A text gets the language of lowest cross-entropy by character. Its score is the posterior over the languages from at
most EVIDENCE characters.

A text is rejected where no model expects it: where its cross-entropy is over the limit of its language, which is
calibrated on all training rows: their 99.9 % quantile and SLACK nats, more for short texts, which tell less.

Bounds: the broadcast table has at most MAX_CELLS numbers, whatever the input. Where the grams need more, the counts of
all orders stay tables in the shared folder, only the most frequent grams are broadcast, and the other grams of a text
are joined with the tables. The size changes where a gram is looked up, not its probability: every gram counts.

Defined cases: null text, or one without a letter, is `und` with score 0 and rejected; rows whose text or language is
null are not learned from; ties go to the language first in order; without training rows all is `und`; an empty table
gives no rows. Columns other than those named are not read, and only text is an input of a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import textvec
from lodestone.llm.common import arrow_schema, keep_rows, map_batches, materialize, text_slices

MAX_CELLS = 16_000_000
EVIDENCE = 60
SLACK, SLACK_CHARS = 1.0, 30
#: Bytes of text in one vectorised step.
STEP = 1 << 19
_SPACE = 32
_COUNTS = "lang string, gram long, n long"
_REST = "array<struct<gram:bigint,n:bigint>>"
_RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"

_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Code point to symbol: a letter's lower case, else a space."""
    if not _TABLE:
        table = np.full(1 << 16, _SPACE, np.uint16)
        for i in range(1 << 16):
            if (c := chr(i)).isalpha():
                low = ord(c.lower()[0])
                table[i] = low if low < 1 << 16 else i
        _TABLE.append(table)
    return _TABLE[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams, offset of each text and the total). A gram is four 16-bit symbols; texts start with three spaces."""
    data, off = textvec.utf8(texts)
    points = np.frombuffer(data[:-8].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    symbols = _symbols()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):  # rare: letters beyond the first plane share symbols
        symbols[i] = 0xE000 | (int(points[i]) & 0xFFF) if chr(points[i]).isalpha() else _SPACE
    letter = symbols != _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = np.concatenate([[0], ends[:-1]])
    inner = first[(first < len(points)) & (first < ends)]
    keep[inner] = letter[inner]  # a space that follows another text's letter
    doc = np.searchsorted(ends, np.flatnonzero(keep), "right")
    sizes = np.bincount(doc, minlength=len(texts))
    base = np.cumsum(sizes + 4) - (sizes + 4)
    out = np.full(int((sizes + 4).sum()), _SPACE, np.uint64)
    out[np.arange(len(doc)) + 3 + 4 * doc] = symbols[keep]
    n = np.where(sizes > 0, sizes + 1, 0)
    last = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base + 3, n)
    key = out[last - 3] << np.uint64(48) | out[last - 2] << np.uint64(32) | out[last - 1] << np.uint64(16) | out[last]
    return key, np.concatenate([[0], np.cumsum(n)])


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


class _Order:
    """Counts of one order: sorted keys, their counts, and by context total and number of kinds."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float | None = None):
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.discount = _discount(counts) if discount is None else discount
        self.contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        self.totals = np.bincount(at, self.counts)
        self.kinds = np.bincount(at)

    def interpolate(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        count = _lookup(self.keys, self.counts, keys)
        context = keys >> np.uint64(16)
        total, kinds = _lookup(self.contexts, self.totals, context), _lookup(self.contexts, self.kinds, context)
        seen = np.maximum(total, 1e-9)
        return np.where(total > 0, np.maximum(count - self.discount, 0) / seen + self.discount * kinds / seen * lower, lower)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class KneserNey:
    """Interpolated Kneser-Ney over 4-grams: raw counts at the top, continuation counts below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, discount: float):
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        self.orders = [_Order(keys, counts, discount)]
        for bits in (48, 32, 16):
            keys, counts = np.unique(keys & np.uint64((1 << bits) - 1), return_counts=True)
            self.orders.append(_Order(keys, counts))

    def prob(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), 1 / (1 << 16))
        for bits, order in zip((16, 32, 48, 64), reversed(self.orders), strict=True):
            out = order.interpolate(keys & np.uint64((1 << bits) - 1), out)
        return out


class LanguageModels:
    """Languages, their models, the sorted hash table of log probabilities, and the limits of rejection."""

    def __init__(self, langs: list[str], models: list[KneserNey]):
        self.langs, self.models = langs, models
        self.limits = np.full(len(langs), np.inf)
        keys = np.unique(np.concatenate([m.orders[0].keys for m in models])) if models else np.zeros(0, np.uint64)
        self.index(keys, np.stack([np.log(m.prob(keys)) for m in models], 1) if models else np.zeros((0, 0)))

    def index(self, keys: np.ndarray, logs: np.ndarray) -> None:
        """Make these grams and their log probabilities the table."""
        hashes = textvec.mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[order].astype(np.float32)
        self.bits = max(4, int(len(keys)).bit_length())
        self.directory = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each gram in the table, -1 where there is none."""
        h = textvec.mix(keys)
        at = self.directory[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        row = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            inside = at < len(self.hashes)
            left, at = left[inside], at[inside]
            there = self.hashes[at]
            hit = there == h[left]
            row[left[hit]] = at[hit]
            more = there < h[left]
            left, at = left[more], at[more] + 1
        return row

    def cross_entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(nats by character for each text and language, number of characters)."""
        keys, off = grams(texts)
        row = self.find(keys)
        logs = self.logs[row]
        if (missing := np.flatnonzero(row < 0)).size:
            rare, back = np.unique(keys[missing], return_inverse=True)
            logs[missing] = np.stack([np.log(m.prob(rare)) for m in self.models], 1).astype(np.float32)[back]
        n = np.diff(off)
        return -self._sums(logs, off) / np.maximum(n, 1)[:, None], n

    def _sums(self, logs: np.ndarray, off: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(off) - 1, len(self.langs)))
        for j in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(logs[:, j], dtype=np.float64)])
            sums[:, j] = total[off[1:]] - total[off[:-1]]
        return sums

    def partial(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(sum of the log probabilities that the table has, number of characters, the other grams with counts)."""
        keys, off = grams(texts)
        row = self.find(keys)
        logs = np.zeros((len(keys), len(self.langs)), np.float32)
        logs[row >= 0] = self.logs[row[row >= 0]]
        missing = np.flatnonzero(row < 0)
        pairs = np.stack([np.searchsorted(off, missing, "right").astype(np.uint64) - np.uint64(1), keys[missing]], 1)
        pairs, counts = np.unique(pairs, axis=0, return_counts=True)
        rest = pa.StructArray.from_arrays([pa.array(pairs[:, 1].copy().view(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "n"])
        ends = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1, dtype=np.uint64)).astype(np.int32)
        return self._sums(logs, off), np.diff(off), pa.ListArray.from_arrays(pa.array(ends), rest)

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, least cross-entropy, rejected) of each text."""
        rows = len(texts)
        return self.judge(*(self.cross_entropies(texts) if self.langs else (np.zeros((rows, 1)), np.zeros(rows, np.int64))))

    def judge(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As decide, from the nats by character and the number of characters."""
        rows = len(n)
        known, best = n > 0, entropy.argmin(1)
        least = entropy[np.arange(rows), best]
        odds = np.exp((least[:, None] - entropy) * np.minimum(n, EVIDENCE)[:, None])
        names = np.array([*self.langs, "und"], object)[np.where(known, best, len(self.langs))]
        slack = SLACK * (1 + SLACK_CHARS / np.maximum(n, 1))
        rejected = ~known | (least > (self.limits[best] if self.langs else 0.0) + slack)
        return names, np.where(known, 1 / odds.sum(1), 0.0), least, rejected


class StoredModels:
    """Models whose grams are too many for one broadcast.

    head: the most frequent grams, a broadcast table of at most MAX_CELLS numbers. orders: from 4-grams down, the bits
    of a key, its counts by language, total and kinds by language of its context, and the discounts. All keys are there.
    """

    def __init__(self, counts: DataFrame, langs: list[str]):
        self.langs, self.orders = langs, []
        rows = counts.select((F.array_position(F.lit(langs), F.col("lang")) - 1).cast("int").alias("l"), F.col("gram").alias("key"), "n")
        for bits in (64, 48, 32, 16):
            if bits < 64:
                rows = rows.select("l", _low(F.col("key"), bits).alias("key")).groupBy("l", "key").agg(F.count(F.lit(1)).alias("n"))
            rows = materialize(rows, "order-counts")
            discounts = [0.5] * len(langs)
            for r in rows.groupBy("l").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
                discounts[r["l"]] = min(0.95, max(0.1, r["once"] / (r["once"] + 2 * r["twice"]))) if r["once"] else 0.5
            by_lang = lambda value: F.map_from_entries(F.collect_list(F.struct("l", value)))
            cells = materialize(rows.groupBy("key").agg(by_lang(F.col("n")).alias("counts")), "order-cells")
            sums = rows.groupBy("l", F.shiftrightunsigned("key", 16).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            contexts = materialize(sums.groupBy("context").agg(by_lang(F.struct("total", "kinds")).alias("seen")), "order-contexts")
            self.orders.append((bits, cells, contexts, discounts))
        weights = counts.groupBy("gram").agg(F.sum("n").alias("weight"))
        most = MAX_CELLS // len(langs)
        share = min(1.0, 1 - most / max(1, self.orders[0][1].count()) + 1e-4)  # the quantile errs by 1e-4 at most
        cut = weights.select(F.percentile_approx("weight", max(0.0, share), 10_000)).first()[0]
        head = self.log_probs(materialize(weights.where(F.col("weight") > cut).select("gram"), "head")).toArrow()  # at most MAX_CELLS numbers
        self.head = LanguageModels([], [])
        self.head.langs, self.head.limits = langs, np.full(len(langs), np.inf)
        logs = pc.list_flatten(head["logs"]).to_numpy().reshape(-1, len(langs))
        self.head.index(head["gram"].to_numpy().view(np.uint64), logs)

    @property
    def limits(self) -> np.ndarray:
        return self.head.limits

    def log_probs(self, wanted: DataFrame) -> DataFrame:
        """gram, logs by language, for a table of grams. A key meets at most 65536 keys of the next order."""
        lower = None
        for bits, cells, contexts, discounts in reversed(self.orders):
            keys = wanted.select(_low(F.col("gram"), bits).alias("key")).distinct().withColumn("context", F.shiftrightunsigned("key", 16))
            keys = keys.join(cells, "key", "left").join(contexts, "context", "left")
            if lower is None:
                keys = keys.withColumn("lower", F.array_repeat(F.lit(1 / (1 << 16)), len(self.langs)))
            else:
                keys = keys.withColumn("low", _low(F.col("key"), bits - 16)).join(lower, "low")

            lower = keys.select(F.col("key").alias("low"), F.transform("lower", _interpolated(F.lit(discounts))).alias("lower"))
        return lower.select(F.col("low").alias("gram"), F.transform("lower", lambda p: F.ln(p).cast("float")).alias("logs"))

    def entropies(self, docs: DataFrame, text: Column) -> DataFrame:
        """row (all columns of docs), entropy by language, number of characters, for every row."""
        keyed = docs.select(F.struct("*").alias("row"), text.cast("string").alias("text"), F.monotonically_increasing_id().alias("key"))
        schema = T.StructType([keyed.schema["row"], *T._parse_datatype_string(f"key long, sums array<double>, n long, rest {_REST}").fields])
        shared = docs.sparkSession.sparkContext.broadcast(self.head)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_slices(batches, limit=STEP):
                sums, n, rest = shared.value.partial(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), lists, pa.array(n), rest], names=schema.names)

        parts = materialize(map_batches(keyed, run, schema), "head-sums")
        rest = parts.select("key", F.inline("rest"))
        found = materialize(self.log_probs(materialize(rest.select("gram").distinct(), "rest")), "rest-logs")
        sums = rest.join(found, "gram").groupBy("key").agg(F.array(*(F.sum(F.col("n") * F.col("logs")[i].cast("double")) for i in range(len(self.langs)))).alias("more"))
        total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
        return parts.join(sums, "key", "left").select("row", F.transform(total, lambda x: -x / F.greatest("n", F.lit(1))).alias("entropy"), "n")

    def decided(self, docs: DataFrame, text: Column, answer: Callable, schema: str | T.StructType) -> DataFrame:
        """The rows of answer(row, judgement) over all rows of docs."""
        shared, width = docs.sparkSession.sparkContext.broadcast(self.head), len(self.langs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entropy = batch.column("entropy").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                yield answer(batch.column("row"), shared.value.judge(entropy, batch.column("n").to_numpy()))

        return map_batches(self.entropies(docs, text), run, schema)


def _interpolated(discounts: Column) -> Callable[[Column, Column], Column]:
    """_Order.interpolate for (probability of the lower order, number of the language)."""

    def prob(low: Column, i: Column) -> Column:
        d, count, seen = F.get(discounts, i), F.coalesce(F.col("counts")[i], F.lit(0)), F.col("seen")[i]
        return F.when(seen["total"] > 0, F.greatest(count - d, F.lit(0.0)) / seen["total"] + d * seen["kinds"] / seen["total"] * low).otherwise(low)

    return prob


def _low(key: Column, bits: int) -> Column:
    return key if bits == 64 else key.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of lang, text."""
    schema = arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = defaultdict(list), 0

        def united() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], schema=schema)

        for batch in text_slices(batches, limit=STEP):
            keys, off = grams(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            of_gram = np.repeat(langs.indices.to_numpy(), np.diff(off))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                found = np.unique(keys[of_gram == i], return_counts=True)
                held[lang].append(found)
                size += len(found[0])
            if size > 2_000_000:
                yield from united()
                held.clear()
                size = 0
        yield from united()

    return map_batches(docs.select("lang", "text"), run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _trained(counts: DataFrame, stats: list) -> LanguageModels:
    kept = counts.toArrow()  # at most MAX_CELLS rows
    langs, keys, n = kept["lang"].to_numpy(zero_copy_only=False), kept["gram"].to_numpy().view(np.uint64), kept["n"].to_numpy()
    models = []
    for r in stats:
        own = langs == r["lang"]
        discount = min(0.95, max(0.1, r["once"] / (r["once"] + 2 * r["twice"]))) if r["once"] else 0.5
        models.append(KneserNey(keys[own], n[own], discount))
    return LanguageModels([r["lang"] for r in stats], models)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None) -> LanguageModels | StoredModels:
    """Models of all languages among the rows that `learn` picks, with limits calibrated on the same rows."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = materialize(count_grams(rows), "gram-counts")
    stats = counts.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).orderBy("lang").collect()
    if not stats:
        return LanguageModels([], [])
    if sum(r["kinds"] for r in stats) > MAX_CELLS // len(stats):
        model = StoredModels(counts, [r["lang"] for r in stats])
    else:
        model = _trained(counts, stats)
    found = predict(rows, model).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", 0.999, 10_000).alias("limit"))
    for r in found.collect():
        if r["lang_pred"] in model.langs:
            model.limits[model.langs.index(r["lang_pred"])] = r["limit"]
    return model


def predict(docs: DataFrame, model: LanguageModels | StoredModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected for every row."""
    schema = arrow_schema(_RESULT)

    def result(ids: pa.Array, judged: tuple) -> pa.RecordBatch:
        names, score, least, over = judged
        return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(score), pa.array(least, mask=names == "und"), pa.array(over)], schema=schema)

    if isinstance(model, StoredModels):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
        return model.decided(rows, F.col("_text"), lambda row, judged: result(row.field("doc_id"), judged), _RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=STEP):
            yield result(batch.column("doc_id"), shared.value.decide(batch.column("text")))

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, _RESULT)


def accepted(docs: DataFrame, model: LanguageModels | StoredModels, text_col: str = "text") -> DataFrame:
    """The rows of docs that the models don't reject, with all their columns."""
    if isinstance(model, StoredModels):

        def keep(row: pa.Array, judged: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([row.filter(pa.array(~judged[3]))], names=["row"])

        return model.decided(docs, F.col(text_col), keep, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda batch: ~shared.value.decide(batch.column(text_col))[3], text_col, STEP)
