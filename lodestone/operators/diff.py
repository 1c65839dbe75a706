"""Line diffs, their review and their merging: one row for each file, small Python helpers inside Arrow batches."""

from __future__ import annotations

import difflib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrays import bound

CONTEXT = 3
_CHANGE = "struct<type:string,line_number_old:int,line_number_new:int,content:string>"
_HUNKS = f"array<struct<hunk_id:string,old_start:int,old_lines:int,new_start:int,new_lines:int,changes:array<{_CHANGE}>>>"


KEPT, GONE, NEW = "context", "deletion", "addition"


def edit_rows(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(kind, lines of old before, lines of new before) for each line of either text, in order."""
    rows, i, j = [], 0, 0
    for a, b, n in difflib.SequenceMatcher(None, old, new).get_matching_blocks():
        rows += [(GONE, k, j) for k in range(i, a)] + [(NEW, a, k) for k in range(j, b)] + [(KEPT, a + k, b + k) for k in range(n)]
        i, j = a + n, b + n
    return rows


def hunk_numbers(rows: list[tuple[str, int, int]]) -> list[int]:
    """Number of the hunk of each row, from 1; 0 for lines farther than CONTEXT from any change."""
    near, hunk, out = [False] * len(rows), 0, []
    for n, row in enumerate(rows):
        if row[0] != KEPT:
            near[max(0, n - CONTEXT) : n + CONTEXT + 1] = [True] * len(near[max(0, n - CONTEXT) : n + CONTEXT + 1])
    for n, inside in enumerate(near):
        hunk += inside and not (n and near[n - 1])
        out.append(hunk if inside else 0)
    return out


def hunk_rows(original: str, patched: str) -> list[dict]:
    """Changes with CONTEXT lines around them; lines are numbered from 1."""
    old, new, out = original.splitlines(), patched.splitlines(), {}
    rows = edit_rows(old, new)
    for (kind, i, j), hunk in zip(rows, hunk_numbers(rows), strict=True):
        if hunk:
            own = out.setdefault(hunk, {"hunk_id": f"hunk_{hunk:03d}", "old_start": i + 1, "old_lines": 0, "new_start": j + 1, "new_lines": 0, "changes": []})
            own["old_lines"] += kind != NEW
            own["new_lines"] += kind != GONE
            own["changes"].append({"type": kind, "line_number_old": None if kind == NEW else i + 1, "line_number_new": None if kind == GONE else j + 1, "content": new[j] if kind == NEW else old[i]})
    return list(out.values())


def apply_accepted(original: str, patched: str, rejected: set[str]) -> str:
    """The patched text with the lines of rejected hunks as they were."""
    old, new = original.splitlines(), patched.splitlines()
    rows = edit_rows(old, new)
    out = []
    for (kind, i, j), hunk in zip(rows, hunk_numbers(rows), strict=True):
        if kind != (NEW if f"hunk_{hunk:03d}" in rejected else GONE):
            out.append(new[j] if kind == NEW else old[i])
    return "\n".join(out) + ("\n" if out and (original.endswith("\n") or patched.endswith("\n")) else "")


def replay_delta(original: str, patched: str, current: str) -> str:
    """The edits from original to patched on the lines of current, line ends as they are, by line position: it may
    misplace them where current has drifted, which callers accept."""
    if current == original or patched == original:
        return patched if current == original else current
    old, new, now = (text.splitlines(keepends=True) for text in (original, patched, current))
    rows = edit_rows(old, new)
    said = [new[j] if kind == NEW else "".join(now[i : i + 1]) for kind, i, j in rows if kind != GONE]
    return "".join([*said, *now[len(old) :]])


def common_lines(one: str, other: str) -> int:
    """Length of the longest common subsequence of lines."""
    rows, columns = one.split("\n"), other.split("\n")
    before = [0] * (len(columns) + 1)
    for line in rows:
        now = [0]
        for j, other_line in enumerate(columns):
            now.append(before[j] + 1 if line == other_line else max(before[j + 1], now[j]))
        before = now
    return before[-1]


def line_edits(one: str, other: str) -> list[dict]:
    """The lines of a longest common subsequence and what is removed and added around them; where both would do, a line
    is removed first. One bit is kept for each pair of lines."""
    old, new = one.split("\n"), other.split("\n")
    codes = {line: n for n, line in enumerate(dict.fromkeys(old + new))}
    right = np.array([codes[line] for line in new])
    longest, removal = np.zeros(len(new) + 1, np.int32), []
    for line in reversed(old):
        below = longest
        longest = np.zeros_like(below)
        reach = np.maximum(below[:-1], np.where(right == codes[line], below[1:] + 1, 0))
        longest[:-1] = np.maximum.accumulate(reach[::-1])[::-1]
        removal.append(np.packbits(below[:-1] >= longest[1:]))
    out, j = [], 0
    row = lambda kind, text, i, k: out.append({"type": kind, "text": text, "old_line": i, "new_line": k})
    for i, line in enumerate(old, 1):
        bits = np.unpackbits(removal[-i])
        while j < len(new) and line != new[j] and not bits[j]:
            j += 1
            row("added", new[j - 1], None, j)
        if j < len(new) and line == new[j]:
            j += 1
            row("same", line, i, j)
        else:
            row("removed", line, i, None)
    for k in range(j, len(new)):
        row("added", new[k], None, k + 1)
    return out


def _by_row(fn, kind: str, *columns: str | Column) -> Column:
    """fn over the rows of Arrow batches; null texts count as empty."""

    def run(*batches: pd.Series) -> pd.Series:
        return pd.Series([fn(*("" if x is None else x for x in row)) for row in zip(*batches, strict=True)], dtype="object")

    return F.pandas_udf(run, kind)(*columns)


def hunks(original: str | Column, patched: str | Column) -> Column:
    return _by_row(hunk_rows, _HUNKS, original, patched)


def partial_apply(original: str | Column, patched: str | Column, rejected: str | Column) -> Column:
    return _by_row(lambda a, b, ids: apply_accepted(a, b, set(ids)), "string", original, patched, rejected)


def delta_merge(original: str | Column, patched: str | Column, current: str | Column) -> Column:
    return _by_row(replay_delta, "string", original, patched, current)


def shared_lines(one: str | Column, other: str | Column) -> Column:
    return _by_row(common_lines, "int", one, other)


def edit_script(one: str | Column, other: str | Column) -> Column:
    return _by_row(line_edits, "array<struct<type string, text string, old_line int, new_line int>>", one, other)


def change_counts(df: DataFrame, key: str, changes: str = "hunks") -> DataFrame:
    """key, additions, deletions over all hunks."""
    kinds = F.flatten(F.transform(changes, lambda h: F.transform(h["changes"], lambda c: c["type"])))
    of = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))
    return df.select(key, of(NEW).alias("additions"), of(GONE).alias("deletions"))


def splice(content: Column, replacements: Column) -> Column:
    """content with line ranges (start_line, end_line, replacement) replaced; ranges out of the text are left out, and
    so is a final newline's absence or presence kept."""
    ended = content.endswith("\n")
    lines = F.split(F.when(ended, F.substring(content, F.lit(1), F.length(content) - 1)).otherwise(content), "\n")
    inside = F.filter(replacements, lambda r: (r["start_line"] >= 1) & (r["end_line"] >= r["start_line"]) & (r["end_line"] <= F.size(lines)))
    plain = lambda r: F.array(F.regexp_replace(r["replacement"], r"\n$", ""))

    def between(own: Column) -> Column:
        """Of ranges in order and apart: the lines up to each, what replaces it, and the lines behind the last."""
        last = F.coalesce(F.get(own, F.size(own) - 1)["end_line"], F.lit(0))
        pieces = F.transform(own, lambda r, j: bound(F.when(j > 0, F.get(own, j - 1)["end_line"]).otherwise(0), lambda done: F.concat(F.slice(lines, done + 1, r["start_line"] - 1 - done), plain(r))))
        return F.concat(F.flatten(pieces), F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(0))))

    def one_by_one(own: Column) -> Column:
        """Where ranges meet, each line says what stands in its place; of several ranges the last given counts."""
        at = lambda i, r: F.when(i + 1 == r["start_line"], plain(r)).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(lines, lambda line, i: F.aggregate(inside, F.array(line), lambda acc, r: F.when((i + 1 >= r["start_line"]) & (i + 1 <= r["end_line"]), at(i, r)).otherwise(acc))))

    meets = lambda own: F.exists(F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.size(own)), lambda a, b: b["start_line"] <= a["end_line"]), lambda x: x)
    replaced = bound(F.sort_array(inside), lambda own: F.when(meets(own), one_by_one(own)).otherwise(between(own)))
    return F.concat(F.array_join(replaced, "\n"), F.when(ended, "\n").otherwise(""))


def merged_blocks(blocks: DataFrame, file: str = "file") -> DataFrame:
    """file, start_line, end_line, context_type, name: blocks of one file that share a line as one.

    Of several kinds a merged block is `merged_block`; it has a name where all agree.
    """
    order = Window.partitionBy(file).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = blocks.withColumn("_new", F.when(reach.isNull() | (F.col("start_line") > reach), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = lambda c, other: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(other)
    return islands.groupBy(file, "_island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), one("context_type", F.lit("merged_block")).alias("context_type"), one("name", F.lit(None).cast("string")).alias("name")).drop("_island")


#: How tools write the place of an error, in order of preference.
LOCATION_PATTERNS = (r'File "([^"]+)", line (\d+)', r"(?m)^\s*-->\s*([^\s:]+):(\d+):\d+", r"([\w./\\-]+\.\w+):(\d+):\d+", r"([\w./\\-]+\.\w+)\((\d+),\d+\)", r"([\w./\\-]+\.\w+):(\d+)\b")


def error_locations(outputs: DataFrame, key: str, text: str, per_file: int = 6) -> DataFrame:
    """key, file, line, pattern, pos of the first locations of each file, ordered by pattern and place."""
    found = F.array(*(_located(text, p, i) for i, p in enumerate(LOCATION_PATTERNS)))
    rows = outputs.select(key, F.inline(F.flatten(found)))
    rank = F.row_number().over(Window.partitionBy(key, "file").orderBy("pattern", "pos"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= per_file).drop("_n")


def _located(text: str, pattern: str, number: int) -> Column:
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda f, n: F.struct(f.alias("f"), n.alias("n")))
    return F.transform(pairs, lambda x, j: F.struct(F.lit(number).alias("pattern"), j.alias("pos"), x["f"].alias("file"), x["n"].cast("int").alias("line")))


def json_object(text: str) -> str | None:
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], sort_keys=True)
        except ValueError:
            at = text.find("{", at + 1)
    return None


def first_json_object(text: str | Column) -> Column:
    """The first JSON object of a text, fenced or not, as normalised JSON; null where there is none."""
    return _by_row(json_object, "string", text)
