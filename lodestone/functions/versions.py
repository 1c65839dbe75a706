"""Version arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_version(v: Column) -> Column:
    """Without range operators before, anything from the first comma on, and leading v."""
    cut = F.regexp_replace(F.regexp_replace(v, r"^[=~^<>!\s]+", ""), r",.*$", "")
    return F.regexp_replace(cut, r"^v+", "")


def strip_range(v: Column) -> Column:
    """Without a leading mix of range operators, v and spaces."""
    return F.regexp_replace(v, r"^[\^~=<>vV\s]+", "")


def severity_parts(v: Column) -> Column:
    """[major, minor, patch]; what is missing or no number is 0."""
    body = F.regexp_replace(v, r"^\D+", "")
    part = lambda i: F.coalesce(F.regexp_extract(body, r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("bigint"), F.lit(0))
    return F.array(part(1), part(2), part(3))


def version_tuple(v: Column) -> Column:
    """The first four digit runs, as integers."""
    return F.slice(F.transform(F.regexp_extract_all(v, F.lit(r"(\d+)")), lambda x: x.try_cast("int")), 1, 4)


def versions_in_text(text: Column) -> Column:
    """Dotted versions of two to four parts, not inside longer digit runs, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\d)v?(\d+\.\d+(?:\.\d+){0,2})(?!\d)"), F.lit(1))


def version_in_window(v: Column, low: Column, high: Column) -> Column:
    """(major(low), 0, 0) <= v <= high in tuple order; a missing bound lets all pass, an empty version none."""
    own, a, b = version_tuple(v), version_tuple(low), version_tuple(high)
    lo, hi = F.least(a, b), F.greatest(a, b)
    floor = F.array(F.get(lo, F.lit(0)), F.lit(0), F.lit(0))
    bounded = F.coalesce(F.size(a), F.lit(0)) * F.coalesce(F.size(b), F.lit(0)) > 0
    return F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, F.lit(False)).when(~bounded, F.lit(True)).otherwise((floor <= own) & (own <= hi))


def severity(current: Column, latest: Column, n_cves: Column, pinned: Column | None = None) -> Column:
    """CRITICAL with advisories, else by the first version part that is behind; UNPINNED where nothing is pinned."""
    c, n = severity_parts(current), severity_parts(latest)
    at = lambda a, i: F.get(a, F.lit(i))
    known = (F.coalesce(current, F.lit("unknown")) != "unknown") & (F.coalesce(latest, F.lit("unknown")) != "unknown")
    graded = (
        F.when(n_cves > 0, "CRITICAL")
        .when(~known, "OK")
        .when(at(c, 0) < at(n, 0), "HIGH")
        .when((at(c, 0) == at(n, 0)) & (at(c, 1) < at(n, 1)), "MEDIUM")
        .when((at(c, 0) == at(n, 0)) & (at(c, 1) == at(n, 1)) & (at(c, 2) < at(n, 2)), "LOW")
        .otherwise("OK")
    )
    return graded if pinned is None else F.when(~pinned | (F.coalesce(current, F.lit("unknown")) == "unknown"), "UNPINNED").otherwise(graded)


def candidate_versions(current: Column, latest: Column) -> Column:
    """Versions worth a look between two: both ends, x.0.0 of both majors, then the minors between (same major, at most
    12) or the next majors (at most 12) and four minors after the current; distinct, the first 16."""
    c, n = severity_parts(current), severity_parts(latest)
    major, minor = (lambda a: F.get(a, F.lit(0))), (lambda a: F.get(a, F.lit(1)))
    dotted = lambda a, b: F.concat(a.cast("string"), F.lit("."), b.cast("string"), F.lit(".0"))
    between = F.when(
        (major(c) == major(n)) & (minor(n) >= minor(c)) & (minor(n) - minor(c) <= 12),
        F.transform(F.sequence(minor(c), minor(n)), lambda m: dotted(major(c), m)),
    ).otherwise(
        F.when(
            (major(n) > major(c)) & (major(n) - major(c) <= 12),
            F.concat(
                F.transform(F.sequence(major(c) + 1, major(n)), lambda m: dotted(m, F.lit(0))),
                F.transform(F.sequence(minor(c) + 1, minor(c) + 4), lambda m: dotted(major(c), m)),
            ),
        ).otherwise(F.array().cast("array<string>"))
    )
    ends = F.array(clean_version(current), clean_version(latest), dotted(major(c), F.lit(0)), dotted(major(n), F.lit(0)))
    return F.slice(F.array_distinct(F.filter(F.concat(ends, between), lambda v: v != "")), 1, 16)


def repin(content: Column, package: Column, old: Column, new: Column) -> Column:
    """Every `package ... old` on a line gets the new version; the text between stays."""
    quote = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?i)("), quote(package), F.lit(r"[^\d\n]*)"), quote(old))
    return F.regexp_replace(content, pattern, F.concat(F.lit("$1"), F.replace(new, F.lit("$"), F.lit(r"\$"))))
