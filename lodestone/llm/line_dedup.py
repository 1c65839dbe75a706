"""Removal of recurring lines by a log-template tree, with Spark expressions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its LEADING first tokens, where a token with
a digit counts as the variable field `<*>`. In a leaf that enough documents reach, a token that enough documents have
at its place is constant and any other a variable field; the line with its fields as `<*>` is its template. A
template whose constant part is at least CONSTANT of its tokens and that recurs in `min_docs` documents is
boilerplate: its lines are dropped from all documents.

A first pass keeps two numbers for each line, its leaf; only lines of leaves that enough documents reach are read in full.
Lines are united before their tokens are counted, so a line that a third of the documents
have costs one row; leaves, lines, constants and templates that many rows share are joined through salted pairs, so no
group meets in one task, and none is collected but the tokens of one line. A document that has two lines of a leaf
counts once for each.

Rows, leaves, lines and templates go by two 64-bit hashes each: two of a table's n values are confused with a chance of
n * n / 2**129.

A text is split once for all that is read of it, so time is linear in its lines.

Defined cases: null text has no lines, empty text one empty line; lines without a token are never dropped; rows that
share an id but not the text are documents of their own, rows that share both are one; a null id is an id like any
other; an empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrays import bound
from lodestone.llm.common import materialize, spread_join

LEADING, CONSTANT, FIELD = 3, 0.6, "<*>"
#: A token with a digit. It is tried at the beginnings of tokens alone and never goes back.
_WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def spaced(line: Column) -> Column:
    """The tokens joined by one space; empty for a line of spaces."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]++", " "))


def generalised(tokens: Column) -> Column:
    """Spaced tokens, those with digits as FIELD."""
    return F.regexp_replace(tokens, _WITH_DIGIT, FIELD)


def _hashes(name: str, *values: Column) -> list[Column]:
    """name1, name2: two hashes of the values."""
    return [F.xxhash64(*values).alias(f"{name}1"), F.xxhash64(F.lit(name), *values).alias(f"{name}2")]


def _row_hashes(id_col: Column, text: Column) -> list[Column]:
    return _hashes("row", id_col.isNull(), F.coalesce(id_col, F.lit(0)), text)


def recurring_lines(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row1, row2, pos of the lines to drop, template1, template2."""
    row, leaf, line, template = (["row1", "row2"], ["leaf1", "leaf2"], ["line1", "line2"], ["template1", "template2"])
    salt = F.xxhash64(*row)
    text, own_id = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    # The hashes of a whole text are made before its lines are parted, not for each of them.
    hashed = docs.select(*_row_hashes(own_id, text), text.alias("text"))
    rows = hashed.select(*row, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    spoken = rows.select(*row, "pos", spaced(F.col("line")).alias("said")).where("said <> ''")
    n_tokens = F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1
    leafed = materialize(spoken.select(*row, "pos", *_hashes("leaf", n_tokens, generalised(F.substring_index("said", " ", LEADING)))), "leafed-lines")

    of_docs = lambda df, keys: df.select(*keys, *row).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"))
    leaves = of_docs(leafed, leaf).where(F.col("docs") >= min_docs).select(*leaf)
    # Only the lines of such leaves are read again, from their documents.
    wanted = spread_join(leafed, leaves, leaf, salt, "left_semi").groupBy(*row).agg(F.collect_set("pos").alias("wanted"))
    # The text is split once for all its wanted lines.
    said = bound(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda p: F.struct(p.alias("pos"), generalised(spaced(F.get(lines, p))).alias("said"))))
    again = hashed.join(wanted, row).select(*row, F.inline(said))
    lead = F.substring_index("said", " ", LEADING)
    candidates = materialize(again.select(*row, "pos", *_hashes("leaf", n_tokens, lead), *_hashes("line", F.col("said")), "said"), "candidate-lines")

    lines = of_docs(candidates, line).join(candidates.groupBy(*line).agg(*(F.first(c).alias(c) for c in (*leaf, "said"))), line)
    placed = materialize(lines.select(*leaf, *line, "docs", F.posexplode(F.split("said", " ")).alias("place", "token")), "placed-tokens")
    constant = placed.where(F.col("token") != FIELD).groupBy(*leaf, "place", "token").agg(F.sum("docs").alias("total")).where(F.col("total") >= min_docs).select(*leaf, "place", "token")
    held = materialize(spread_join(placed.select(*leaf, *line, "place", "token"), constant, [*leaf, "place", "token"], F.xxhash64(*line), "left_semi"), "constant-tokens")
    # A template is known by its length and its constants with their places.
    sizes = placed.groupBy(*line).agg(F.count(F.lit(1)).alias("n"))
    templated = (
        held.groupBy(*line)
        .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("constants"))
        .join(sizes, line)
        .where(F.size("constants") >= F.lit(CONSTANT) * F.col("n"))
        .select(*line, *_hashes("template", F.col("n"), F.col("constants")))
    )
    found = materialize(spread_join(candidates.select(*row, "pos", *line), templated, line, salt), "templated-lines")
    recurring = of_docs(found, template).where(F.col("docs") >= min_docs).select(*template)
    return spread_join(found, recurring, template, salt, "left_semi")


def drop_recurring_lines(docs: DataFrame, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped per row."""
    text = F.col(text_col).cast("string")
    gone = recurring_lines(docs, min_docs, id_col, text_col).groupBy("row1", "row2").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("*", *_row_hashes(F.col("doc_id"), F.col("text")))
    lines = F.split("text", "\n")
    # Both in time linear in the lines: the places that stay by hashing, the lines from an array split once.
    kept = bound(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), "gone"), lambda p: F.get(own, p)))
    return rows.join(gone, ["row1", "row2"], "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
