"""From model responses to patched files: parsing, validation against block and evidence, keyword pruning, splicing."""

from __future__ import annotations

import ast
import builtins
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import diff

ENVELOPE = "schema_version string, status string, replacements array<struct<start_line:int,end_line:int,replacement:string>>"
_BUILTINS = frozenset(dir(builtins))


def parsed_replacements(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses with replacements and parse_error: the first JSON object of a response under the envelope, an array of
    replacements without it too."""
    found = diff.first_json_object(text)
    rows = responses.withColumn("_json", found).withColumn("_e", F.from_json("_json", ENVELOPE))
    bad = F.exists("_e.replacements", lambda r: r["start_line"].isNull() | r["end_line"].isNull() | r["replacement"].isNull() | (r["start_line"] < 1) | (r["end_line"] < r["start_line"]))
    error = F.when(F.col("_json").isNull(), "no JSON object").when(F.col("_e.replacements").isNull(), "no replacements").when(bad, "malformed replacement")
    return rows.select(*responses.columns, F.col("_e.replacements").alias("replacements"), error.alias("parse_error"))


def matched_blocks(replacements: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, errors: ranges that are no block of the key, or come twice, make the whole response an error."""
    each = replacements.select(key, F.explode("replacements").alias("r")).select(key, "r.start_line", "r.end_line")
    counted = each.groupBy(key, "start_line", "end_line").agg(F.count(F.lit(1)).alias("n"))
    known = blocks.select(key, "start_line", "end_line", F.lit(True).alias("known")).distinct()
    said = counted.join(known, [key, "start_line", "end_line"], "left").select(
        key,
        F.when(F.col("known").isNull(), F.format_string("lines %d-%d are no block", "start_line", "end_line")).when(F.col("n") > 1, F.format_string("lines %d-%d come %d times", "start_line", "end_line", "n")).alias("error"),
    )
    return said.groupBy(key).agg(F.array_sort(F.collect_list("error")).alias("errors"))


def _tree(source: str) -> ast.AST | None:
    try:
        return ast.parse(textwrap.dedent(source))
    except (SyntaxError, ValueError):
        return None


def bare_calls(tree: ast.AST) -> set[str]:
    return {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}


def bound_names(tree: ast.AST) -> set[str]:
    """Names that code defines: functions, classes, arguments, imports, targets."""
    out = set()
    for n in ast.walk(tree):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(n.name)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            out |= {(a.asname or a.name).partition(".")[0] for a in n.names}
        elif isinstance(n, ast.arg):
            out.add(n.arg)
        elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
            out.add(n.id)
    return out


def keywords_of(tree: ast.AST) -> dict[str, set[str]]:
    """Keyword arguments by the last part of the called name."""
    out: dict[str, set[str]] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Call):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
            if name:
                out.setdefault(name, set()).update(k.arg for k in n.keywords if k.arg)
    return out


def block_errors(block: str, replacement: str, matched: list[int], file_source: str, documented: str) -> list[str]:
    """What is wrong with a block's replacement. matched: the block's lines (from 0) that may change; documented: the
    text of the evidence, in which new keywords and helpers have to stand."""
    errors = []
    kept = [line.strip() for i, line in enumerate(block.splitlines()) if i not in set(matched) and line.strip()]
    new_lines = iter(line.strip() for line in replacement.splitlines())
    if lost := [line for line in kept if not any(line == other for other in new_lines)]:
        errors.append(f"unchanged line is missing: {lost[0]}")
    old, new = _tree(block), _tree(replacement)
    if new is None:
        return [*errors, "replacement does not parse"] if old is not None else errors
    whole = _tree(file_source) or ast.parse("")
    known = bound_names(whole) | bound_names(new) | _BUILTINS
    if unknown := sorted(bare_calls(new) - (bare_calls(old) if old else set()) - known):
        errors.append(f"unresolved call: {', '.join(unknown)}")
    inner = [n for f in ast.walk(new) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in ast.walk(f) if isinstance(n, (ast.Import, ast.ImportFrom))]
    had = {ast.dump(n) for n in ast.walk(old) if isinstance(n, (ast.Import, ast.ImportFrom))} if old else set()
    if any(ast.dump(n) not in had for n in inner):
        errors.append("import inside a function")
    before, after = keywords_of(old) if old else {}, keywords_of(new)
    for name in sorted(after):
        if fresh := sorted(k for k in after[name] - before.get(name, set()) if k not in documented):
            errors.append(f"undocumented keyword of {name}: {', '.join(fresh)}")
    return errors


def validated(blocks: DataFrame) -> DataFrame:
    """blocks (block, replacement, matched array<int>, file_source, documented) with errors; no error for a text that
    is no Python but keeps its lines."""

    def run(block: pd.Series, replacement: pd.Series, matched: pd.Series, source: pd.Series, documented: pd.Series) -> pd.Series:
        return pd.Series([block_errors(b or "", r or "", list(() if m is None else m), s or "", d or "") for b, r, m, s, d in zip(block, replacement, matched, source, documented, strict=True)], dtype="object")

    return blocks.withColumn("errors", F.pandas_udf(run, "array<string>")("block", "replacement", "matched", "file_source", "documented"))


def without_keywords(source: str, calls: set[str], dropped: set[str], lines: set[int]) -> str:
    """source without keyword arguments of calls that touch lines (from 1); text elsewhere stays as it is."""
    tree = _tree(source)
    if tree is None or textwrap.dedent(source) != source:
        return source
    rows = source.splitlines(keepends=True)
    at = [0]
    for row in rows:
        at.append(at[-1] + len(row.encode()))
    data, cuts = source.encode(), []
    for n in ast.walk(tree):
        name = n.func.attr if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) else None
        if name not in calls or not lines & set(range(n.lineno, n.end_lineno + 1)):
            continue
        for k in n.keywords:
            if k.arg in dropped:
                a, b = at[k.lineno - 1] + k.col_offset, at[k.end_lineno - 1] + k.end_col_offset
                after = data[b:].lstrip()
                if after.startswith(b","):
                    b = len(data) - len(after[1:].lstrip(b" "))
                else:
                    a = len(data[:a].rstrip().removesuffix(b","))
                cuts.append((a, b))
    for a, b in sorted(cuts, reverse=True):
        data = data[:a] + data[b:]
    return data.decode()


def pruned(blocks: DataFrame) -> DataFrame:
    """blocks (replacement, calls, deprecated arrays, matched array<int> from 0) with deprecated keywords taken out."""

    def run(replacement: pd.Series, calls: pd.Series, deprecated: pd.Series, matched: pd.Series) -> pd.Series:
        return pd.Series([without_keywords(r or "", set(c), set(d), {int(m) + 1 for m in ms}) for r, c, d, ms in zip(replacement, calls, deprecated, matched, strict=True)], dtype="object")

    return blocks.withColumn("replacement", F.pandas_udf(run, "string")("replacement", "calls", "deprecated", "matched"))


def patched_files(files: DataFrame, accepted: DataFrame, key: str = "file") -> DataFrame:
    """key, content with all accepted replacements (key, start_line, end_line, replacement) spliced in."""
    packed = accepted.groupBy(key).agg(F.collect_list(F.struct("start_line", "end_line", "replacement")).alias("_r"))
    none: Column = F.array().cast("array<struct<start_line:int,end_line:int,replacement:string>>")
    return files.join(packed, key, "left").select(key, diff.splice(F.col("content"), F.coalesce("_r", none)).alias("content"))
