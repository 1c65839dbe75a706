"""Chat formatting with Spark expressions: sort a conversation's turns, merge neighbours of one role, concatenate.

Output: `<s>` + blocks + `</s>`, a block being `[ROLE role]` text `[/ROLE]`; turns merged into one block are parted
by `[NEXT]`. Inside texts and roles every `[`, `]`, `<`, `>` and `\\` gets a `\\` before it, so no text can hold a
control string; taking the `\\` away again gives back the text. The loss mask is the texts of assistant blocks.

Defined cases: turns are ordered by turn, then role and text (a null turn first); repeated rows are turns of their
own; null text is empty, null role is the empty role; rows of a null conv_id form one conversation; an empty table
gives no rows. Columns other than the four named are not read. A conversation is one row, so one task holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, HEAD, HEAD_END, TAIL, NEXT = "<s>", "</s>", "[ROLE ", "]", "[/ROLE]", "[NEXT]"
#: Characters that control strings are made of; each is escaped inside texts.
_CONTROL = r"([\[\]<>\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\[\]<>\\])", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted: one string for each conversation."""
    said = F.struct(
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(conv_col).alias("conv_id"), said.alias("said"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    at = F.sequence(F.lit(0), F.size("said") - 1)
    # A turn opens a block unless the turn before it has its role, and closes one unless the next has.
    role = lambda i: F.get(F.col("said"), i)["role"]
    piece = F.transform(
        at,
        lambda i: F.concat(
            F.when(role(i).eqNullSafe(role(i - 1)), F.lit(NEXT)).otherwise(F.concat(F.lit(HEAD), escape(role(i)), F.lit(HEAD_END))),
            escape(F.get(F.col("said"), i)["text"]),
            F.when(role(i).eqNullSafe(role(i + 1)), F.lit("")).otherwise(F.lit(TAIL)),
        ),
    )
    return ordered.select("conv_id", F.concat(F.lit(OPEN), F.array_join(piece, ""), F.lit(CLOSE)).alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role,text>>: read back from the strings alone."""
    # Control strings are the only unescaped brackets: a block runs to the next [/ROLE], its turns to the next [NEXT].
    plain = r"(?:[^\[\]<>\\]++|\\[\[\]<>\\])*+"
    block = rf"\[ROLE ({plain})\]({plain}(?:\[NEXT\]{plain})*+)\[/ROLE\]"
    roles, bodies = (F.regexp_extract_all("formatted", F.lit(block), F.lit(i)) for i in (1, 2))
    said = lambda role, body: F.transform(F.split(body, r"\[NEXT\]"), lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")))
    split = formatted.select("*", roles.alias("_roles"), bodies.alias("_bodies"))
    return split.select(*formatted.columns, F.flatten(F.zip_with("_roles", "_bodies", said)).alias("turns"))


def chat_digest(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted strings."""
    parsed = parse_chats(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
