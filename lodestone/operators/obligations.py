"""What a migration obliges code to, by the evidence: keywords that go, string arguments, context managers."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import evidence_text
from lodestone.operators.retrieval import mentions_context_manager
from lodestone.operators.scan import Spans, in_blocks, occurrences, shortest

#: What a keyword is called, and the characters that may lie between it and that, after and before it.
NOUNS, AFTER, BEFORE = ("keyword", "argument", "parameter", "param", "option", "kwarg"), 80, 100
#: Phrases that mark a keyword's migration, and the stretch around the keyword in which they count.
KEYWORD_MARKS = (
    "does not have", "removed", "remove", "deprecated", "deprecation", "no longer", "not accepted", "not supported", "unexpected keyword", "got an unexpected keyword", "renamed", "replacement",
    "replaced", "instead", "to avoid", "mimics the behavior", "mimics behavior", "should be replaced", "requires", "required",
)
BACK, AHEAD = 250, 400
#: Phrases about string arguments, and words that make them an obligation.
STRING_MARKS = ("passing a string", "string to", "raw string", "textual sql", "textual statement", "string statements require", "sql string")
STRING_MIGRATION = ("deprecated", "removed", "will be removed", "no longer", "requires", "must", "use ")


def keyword_migrations(evidence: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", keyword: str = "keyword") -> DataFrame:
    """key, keyword: where a text marks a keyword's migration. keywords are single words.

    An occurrence of the keyword counts if the stretch from BACK characters before it to AHEAD after its beginning has
    both the keyword in a keyword's role (`name =`, or with one of NOUNS near it and no full stop between) and one of
    KEYWORD_MARKS. All that is looked for is found where a text is read, and a keyword is done with its first occurrence
    that counts.
    """
    names = keywords.select(F.lower(keyword).alias("word")).where("word <> ''")
    found = in_blocks(evidence.select(key, evidence_text(F.col(text)).alias("said")), key, "said", names, "keyword string", _keyword_work)
    return found.select(F.col("key").alias(key), "keyword").distinct()


def _keyword_work(rows: list[tuple[str]]):
    keywords, nouns, marks = {r[0] for r in rows}, set(NOUNS), shortest(KEYWORD_MARKS)
    word, given = re.compile(r"\w+"), re.compile(" ?=")

    def use(said: str):
        marked = Spans((a, a + len(w)) for w in marks for a in occurrences(said, w))
        if not marked.begins:
            return
        places: dict[str, list[int]] = {}
        called: list[tuple[int, int]] = []
        for m in word.finditer(said):
            if (w := m.group()) in keywords:
                places.setdefault(w, []).append(m.start())
            if w in nouns:
                called.append(m.span())
        begins, ends = [a for a, _ in called], [b for _, b in called]
        for w, at in places.items():
            roles = Spans(role for a in at for role in _roles(said, a, a + len(w), begins, ends, given))
            if roles.begins and any(roles.within(a - BACK, a + AHEAD) and marked.within(a - BACK, a + AHEAD) for a in at):
                yield (w,)

    return use


def _roles(said: str, at: int, end: int, begins: list[int], ends: list[int], given: re.Pattern):
    """The shortest stretches that have a keyword in a role: assigned, and with the nearest noun after and before it."""
    if m := given.match(said, end):
        yield at, m.end()
    i = bisect_left(begins, end)
    if i < len(begins) and begins[i] - end <= AFTER and "." not in said[end : begins[i]]:
        yield at, ends[i]
    i = bisect_right(ends, at) - 1
    if i >= 0 and at - ends[i] <= BEFORE and "." not in said[ends[i] : at]:
        yield begins[i], end


def mentions_keyword(text: Column, keyword: Column) -> Column:
    """Whether a text speaks of a keyword at all: with `=`, in quotes or backticks, or called a parameter."""
    said = F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("`"), F.lit("")), r"\s+", " ")
    name = F.concat(F.lit(r"\Q"), F.lower(keyword), F.lit(r"\E"))
    quoted = F.rlike(F.lower(text), F.concat(F.lit("[`'\"]"), name, F.lit("[`'\"]")))
    called = F.rlike(said, F.concat(F.lit(r"\b"), name, F.lit(r"(\s*=|\s+(parameter|argument|option|keyword)\b)")))
    return (keyword != "") & (called | quoted)


def migration_obligations(targets: DataFrame, source: str = "source", evidence: str = "evidence") -> DataFrame:
    """targets with an obligation a row: string_argument where code passes a string literal and the evidence speaks of
    such arguments in words of migration, context_manager where code calls a method and the evidence speaks of one."""
    said = F.regexp_replace(F.replace(F.lower(F.coalesce(evidence, F.lit(""))), F.lit("`"), F.lit("")), r"\s+", " ")
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(said, m))
    string = F.col(source).rlike(r"\w+\s*\(\s*['\"]") & has(STRING_MARKS) & has(STRING_MIGRATION)
    manager = mentions_context_manager(F.col(evidence)) & F.col(source).rlike(r"\.\w+\s*\(")
    kinds = F.filter(F.array(F.when(string, F.lit("string_argument")), F.when(manager, F.lit("context_manager"))), lambda k: k.isNotNull())
    return targets.select("*", F.explode(kinds).alias("obligation"))
