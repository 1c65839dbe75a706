"""Stretches of documents around what is looked for, and stages that each run only on the keys earlier ones left empty."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.operators.intervals import merge_intervals, stabbed
from lodestone.operators.positions import NAMES, near_pairs
from lodestone.operators.relational import first_rows
from lodestone.operators.scan import text_places
from lodestone.sources.storage import stored

#: Characters of a window around an API's name, those that an uncut window may have more; characters
#: around a term, those between two stretches that are joined, stretches of a document, terms that are named.
WINDOW_CHARS, WINDOW_MORE = 1800, 300
TERM_CHARS, TERM_GAP, MOST_STRETCHES, MOST_NAMED = 900, 80, 4, 8


def centred_terms(usages: DataFrame, usage: str = "usage") -> DataFrame:
    """term: what an API is looked for by, its last two parts and, of three or more, its last three and all."""
    whole = F.trim(F.regexp_replace(usage, "::|/", "."))
    names = F.array(tx.last_parts(F.col(usage), 2), tx.last_parts(F.col(usage), 3), F.when(F.size(tx.name_parts(F.col(usage))) >= 3, whole))
    return usages.select(F.explode(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))).alias("term")).distinct()


def mapped_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, said, runs, breaks, code: normalised texts, and what is needed to cut the raw ones by them.

    said: lower case, roles cut to their bodies, no backticks, single blanks. runs: its map to the raw text as runs
    (said_at, raw_at) within which offsets advance alike. breaks: raw offsets of blank lines. code: raw spans of fenced
    blocks (closed by a fence of the same kind, or by the end) and of code directives with their indented lines.
    """
    own = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"))
    out = T.StructType([T.StructField("key", own.schema["key"].dataType), *T._parse_datatype_string("said string, runs array<struct<said_at:int,raw_at:int>>, breaks array<int>, code array<struct<s:int,e:int>>").fields])
    shape = T._parse_datatype_string("runs array<struct<said_at:int,raw_at:int>>, breaks array<int>, code array<struct<s:int,e:int>>")
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(shape)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        left_out = re.compile(r":[A-Za-z_:]+:`~?([^`]+)`|`+|\s+")
        blank, space = re.compile(r"(?=\n\n)"), r"[^\S\n]"
        fence = rf"^{space}*(?P<f>```|~~~)[^\n]*(?:\n(?!{space}*(?P=f))[^\n]*)*(?:\n{space}*(?P=f)[^\n]*\n?|\Z)"
        directive = rf"^(?P<i>{space}*)\.\.{space}+(?:code-block|code)::[^\n]*(?:\n|\Z)(?:{space}*\n|(?P=i){space}+\S[^\n]*(?:\n|\Z))*"
        blocks = re.compile(f"{fence}|{directive}", re.M)

        def mapped(raw: str) -> tuple[str, list[tuple[int, int]]]:
            said, runs, size = [], [], 0

            def give(piece: str, at: int) -> None:
                nonlocal size
                # A new run begins only where the two offsets come apart.
                if not runs or runs[-1][1] - runs[-1][0] != at - size:
                    runs.append((size, at))
                said.append(piece)
                size += len(piece)

            def keep(a: int, b: int) -> None:
                low = raw[a:b].lower()
                # A character whose lower case is longer ends a run.
                for at, piece in [(a, low)] if len(low) == b - a else [(a + j, c.lower()) for j, c in enumerate(raw[a:b])]:
                    if piece:
                        give(piece, at)

            def cut(a: int, b: int) -> None:
                at = a
                for m in left_out.finditer(raw, a, b):
                    keep(at, m.start())
                    if m.group(1) is not None:
                        cut(*m.span(1))
                    elif m.group().isspace() and (not said or not said[-1].endswith(" ")):
                        give(" ", m.start())
                    at = m.end()
                keep(at, b)

            cut(0, len(raw))
            return "".join(said), runs

        for batch in batches:
            rows = [(mapped(raw), raw) for raw in batch.column("raw").to_pylist()]
            columns = [
                batch.column("key"), pa.array([said for (said, _), _ in rows], pa.string()), pa.array([[{"said_at": a, "raw_at": b} for a, b in runs] for (_, runs), _ in rows], kinds[0]),
                pa.array([[m.start() for m in blank.finditer(raw)] for _, raw in rows], kinds[1]), pa.array([[{"s": m.start(), "e": m.end()} for m in blocks.finditer(raw)] for _, raw in rows], kinds[2]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return own.mapInArrow(run, out)


def raw_places(places: DataFrame, mapped: DataFrame) -> DataFrame:
    """places (key, at) with raw: the raw offset of each, by the run that holds it."""
    spans = mapped.select("key", F.posexplode("runs").alias("_i", "_run"), F.col("runs").alias("_all"), F.length("said").alias("_n"))
    spans = spans.select("key", F.col("_run.said_at").alias("_s"), (F.coalesce(F.get("_all", F.col("_i") + 1)["said_at"], F.col("_n")) - 1).alias("_e"), F.col("_run.raw_at").alias("_raw"))
    return stabbed(places, F.col("at"), spans, ["key"], "_s", "_e").withColumn("raw", F.col("_raw") + F.col("at") - F.col("_s")).select(*places.columns, "raw")


def api_windows(references: DataFrame, terms: DataFrame, key: str = "ref_index", text: str = "content", size: int = WINDOW_CHARS) -> DataFrame:
    """key, start, end, content, line_start, line_end, term: windows around names (terms: term) that stand in references
    as whole names, once each.

    A window reaches half its size to both sides, to a blank line beyond if that is within its size, and over code blocks
    that it would cut. Names are found in the normalised text; the map of its offsets to the raw text makes the cuts
    exact. Blank lines and code blocks meet windows by distance and by the bins of their spans.
    """
    raw = references.select(key, F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n")).alias("_text")).where("_text <> ''")
    mapped = stored(mapped_text(raw, key, "_text"), "mapped-texts")
    names = stored(terms.select("term", tx.evidence_text(F.col("term")).alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.min_by("term", F.struct(-F.length("term"), "term")).alias("term")), "window-terms")
    hits = raw_places(text_places(mapped, "key", "said", names, NAMES).select("phrase", "key", "at"), mapped).join(names, "phrase")
    sizes = mapped.select("key", "breaks", "code").join(raw.select(F.col(key).alias("key"), F.length("_text").alias("_length")), "key")
    half = max(size, 800) // 2
    own = hits.join(sizes.select("key", "_length"), "key").select(
        "key", "term", F.col("raw").alias("at"), F.greatest(F.lit(0), F.col("raw") - half).alias("s"), F.least("_length", F.col("raw") + F.length("term") + half).alias("e")
    )
    own = stored(own.distinct(), "windows")
    breaks = mapped.select("key", F.explode("breaks").alias("other"))
    near = near_pairs(own, breaks, ["key"], -2 * half, 2 * half).groupBy("key", "term", "at").agg(F.max(F.when(F.col("other") + 2 <= F.col("s"), F.col("other") + 2)).alias("_s"), F.min(F.when(F.col("other") >= F.col("e"), F.col("other"))).alias("_e"))
    own = own.join(near, ["key", "term", "at"], "left").select("key", "term", "at", F.coalesce("_s", "s").alias("s"), F.coalesce("_e", "e").alias("e"))
    # Code blocks lie apart, so only those that hold an end of a window make it longer, and none meets another by that.
    code = mapped.select("key", F.inline("code")).select("key", F.col("s").alias("_a"), F.col("e").alias("_b"), (F.col("s") + 1).alias("_from"), (F.col("e") - 1).alias("_to"))
    at_start = stabbed(own, F.col("s"), code, ["key"], "_from", "_to").select("key", "term", "at", F.col("_a").alias("_s"))
    at_end = stabbed(own, F.col("e"), code, ["key"], "_from", "_to").select("key", "term", "at", F.col("_b").alias("_e"))
    wide = own.join(at_start, ["key", "term", "at"], "left").join(at_end, ["key", "term", "at"], "left")
    wide = wide.select("key", F.coalesce("_s", "s").alias("s"), F.coalesce("_e", "e").alias("e"), (F.col("_s").isNotNull() | F.col("_e").isNotNull()).alias("code"), "term", "at")
    windows = wide.groupBy("key", "s", "e").agg(F.min(F.struct(-F.length("term"), "term", "at", "code")).alias("w"))
    listed = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e", F.col("w.code").alias("code"), F.col("w.term").alias("term")))).alias("ws"))
    rows = listed.join(raw.withColumnRenamed(key, "key"), "key").select("key", "_text", F.explode("ws").alias("w")).select("key", "_text", "w.*")
    part = F.substring(F.col("_text"), F.col("s") + 1, F.col("e") - F.col("s"))
    said = F.trim(part, F.lit(" \t\r\n"))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = lines(F.substring(F.col("_text"), F.lit(1), F.col("s"))) + 1
    return rows.select(
        F.col("key").alias(key), F.col("s").alias("start"), F.col("e").alias("end"), F.when(F.col("code"), said).otherwise(F.substring(said, F.lit(1), F.lit(size + WINDOW_MORE))).alias("content"),
        before.alias("line_start"), (before + lines(part)).alias("line_end"), "term",
    )


def staged(keys: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The rows of each key's first stage that gives it any, with stage.

    keys: key columns. A stage is given the keys that are still without rows and returns rows with those columns; it
    joins its input with them before its work, so a costly stage works only for what earlier ones left empty.
    """
    names, left, out = keys.columns, keys.distinct(), None
    for i, stage in enumerate(stages):
        rows = stored(stage(left).withColumn("stage", F.lit(i)), f"stage-{i}")
        out = rows if out is None else out.unionByName(rows)
        if i < len(stages) - 1:
            left = stored(left.join(rows.select(*names).distinct(), names, "left_anti"), "keys-left")
    return out


def term_stretches(references: DataFrame, terms: DataFrame, around: int = TERM_CHARS, gap: int = TERM_GAP, most: int = MOST_STRETCHES) -> DataFrame:
    """package, ref_index, content, matched_terms, strong_terms: of references (package, ref_index, content) that speak
    of migration and have a strong term of their package, the first stretches around its terms (package, term, strong).

    A term is looked for anew where it ended, and in lower case whose offsets are those of the text.
    """
    raw = stored(references.select("package", "ref_index", F.trim("content", F.lit(" \t\r\n")).alias("content")).where(tx.has_migration_language(F.col("content"))), "stretch-texts")
    wanted = terms.select("package", tx.lower_in_place(F.col("term")).alias("phrase"), "term", "strong").distinct()
    keyed = raw.select(F.struct("package", "ref_index").alias("key"), "package", tx.lower_in_place(F.col("content")).alias("said"))
    found = text_places(keyed, "key", "said", wanted, group="package", apart=True)
    hits = found.select("phrase", F.col("key.package").alias("package"), F.col("key.ref_index").alias("ref_index"), "at", "end").join(wanted, ["package", "phrase"])
    hits = stored(hits, "stretch-hits")
    named = lambda c: F.slice(F.array_sort(F.collect_set(c), _longest_first), 1, MOST_NAMED)
    told = hits.groupBy("package", "ref_index").agg(named("term").alias("matched_terms"), named(F.when(F.col("strong"), F.col("term"))).alias("strong_terms")).where(F.size("strong_terms") > 0)
    spans = hits.join(raw.select("package", "ref_index", F.length("content").alias("_n")), ["package", "ref_index"]).select("package", "ref_index", F.greatest(F.lit(0), F.col("at") - around).alias("s"), (F.least("_n", F.col("end") + around) + gap).alias("e"))
    islands = merge_intervals(spans, ["package", "ref_index"], "s", "e")
    first = islands.withColumn("_i", F.row_number().over(Window.partitionBy("package", "ref_index").orderBy("s"))).where(F.col("_i") <= most)
    listed = first.groupBy("package", "ref_index").agg(F.array_sort(F.collect_list(F.struct("s", (F.col("e") - gap).alias("e")))).alias("_spans"))

    def snippet(x: Column) -> Column:
        cut = F.trim(F.substring(F.col("content"), x["s"] + 1, x["e"] - x["s"]), F.lit(" \t\r\n"))
        return F.concat(F.when(x["s"] > 0, "... ").otherwise(""), cut, F.when(x["e"] < F.length("content"), " ...").otherwise(""))

    return listed.join(told, ["package", "ref_index"]).join(raw, ["package", "ref_index"]).select("package", "ref_index", F.array_join(F.transform("_spans", snippet), "\n\n---\n\n").alias("content"), "matched_terms", "strong_terms")


def _longest_first(a: Column, b: Column) -> Column:
    return F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)


def focused_snippets(references: DataFrame, terms: DataFrame, in_code: DataFrame, ranked: Callable[[DataFrame], DataFrame], fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """package, ref_index, content, stage: for each package its ranked chunks; where it has none, breaking sections, unless
    its API is known to be used in code (in_code: package); where it has none of these, stretches around its terms.

    references: package, ref_index, title, url, source, content, role. ranked, fallback: functions of references that
    give rows with package, ref_index and content.
    """
    usable = references.where(F.coalesce("role", F.lit("")) != "old_api_docs")
    of = lambda keys: usable.join(keys, "package", "left_semi")
    columns = ["package", "ref_index", "content"]
    stages = [
        lambda keys: ranked(of(keys)).select(*columns),
        lambda keys: fallback(of(keys.join(in_code.select("package").distinct(), "package", "left_anti"))).select(*columns),
        lambda keys: term_stretches(first_rows(of(keys), ["package", "url", F.sha2(F.coalesce("content", F.lit("")), 256)], ["ref_index"]), terms.join(keys, "package", "left_semi")).select(*columns),
    ]
    return staged(references.select("package"), stages)
