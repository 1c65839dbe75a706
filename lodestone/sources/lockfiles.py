"""Lockfiles as rows: lockfile, priority, name_lower, version, ord, in the order in which a name is looked up."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.manifests import _parsed

#: Lockfiles in order of precedence.
PRECEDENCE = ("Pipfile.lock", "poetry.lock", "package-lock.json", "yarn.lock", "Cargo.lock", "go.sum")


def toml_packages(content: str) -> list[tuple[str, str]]:
    return [(p.get("name", ""), p.get("version", "")) for p in tomllib.loads(content).get("package", [])]


def _entry(name: Column, version: Column) -> Column:
    return F.struct(F.lower(name).alias("name"), version.alias("version"))


def pipfile(content: Column) -> Column:
    sections = F.from_json(content, "default map<string,struct<version:string>>, develop map<string,struct<version:string>>")
    entries = [F.coalesce(F.map_entries(sections[s]), F.array().cast("array<struct<key:string,value:struct<version:string>>>")) for s in ("default", "develop")]
    return F.transform(F.concat(*entries), lambda e: _entry(e["key"], F.regexp_replace(e["value"]["version"], "^=+", "")))


def npm_lock(content: Column) -> Column:
    """Names of `packages` without their node_modules parts; of `dependencies` where there are none."""
    data = F.from_json(content, "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>")
    new = F.transform(F.map_entries(data["packages"]), lambda e: _entry(F.replace(e["key"], F.lit("node_modules/"), F.lit("")), e["value"]["version"]))
    old = F.transform(F.map_entries(data["dependencies"]), lambda e: _entry(e["key"], e["value"]["version"]))
    return F.concat(F.coalesce(F.filter(new, lambda e: e["name"] != ""), F.array().cast("array<struct<name:string,version:string>>")), F.coalesce(old, F.array().cast("array<struct<name:string,version:string>>")))


def yarn_lock(content: Column) -> Column:
    """A header line names specifiers, each up to its last @; the next version line belongs to them."""
    lines = F.split(content, r"\R")
    start = F.struct(F.array().cast("array<struct<name:string,version:string>>").alias("out"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, line: Column) -> Column:
        header = line.rlike(r"^[^\s#].*@.*:$")
        names = F.transform(F.split(F.regexp_replace(line, r'[":]+$|"', ""), r",\s*"), lambda s: F.regexp_replace(F.regexp_replace(s, r"@[^@]*$", ""), ":$", ""))
        version = F.regexp_extract(line, r'^\s+version:?\s+"?([^"\s]+)"?', 1)
        found = version != ""
        return F.struct(
            F.when(found, F.concat(acc["out"], F.transform(acc["names"], lambda n: _entry(n, version)))).otherwise(acc["out"]).alias("out"),
            F.when(header, names).when(found, F.array().cast("array<string>")).otherwise(acc["names"]).alias("names"),
        )

    return F.aggregate(lines, start, step, lambda acc: acc["out"])


def go_sum(content: Column) -> Column:
    """Each module under its full name and its last path segment."""
    pattern = r"(?m)^(\S+) (v[^\s/]+) h1:"
    pairs = F.zip_with(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)), _entry)
    return F.flatten(F.transform(pairs, lambda e: F.array(e, F.struct(F.element_at(F.split(e["name"], "/"), -1).alias("name"), e["version"].alias("version")))))


def lock_entries(files: DataFrame) -> DataFrame:
    """lockfile, priority, name_lower, version, ord of the lockfiles among files (name, content)."""
    parsers = {"Pipfile.lock": pipfile, "poetry.lock": _parsed(toml_packages), "package-lock.json": npm_lock, "yarn.lock": yarn_lock, "Cargo.lock": _parsed(toml_packages), "go.sum": go_sum}
    parts = [
        files.where(F.col("name") == name).select(F.lit(name).alias("lockfile"), F.lit(i).alias("priority"), F.posexplode(parsers[name](F.col("content"))).alias("ord", "e")).select("lockfile", "priority", F.lower("e.name").alias("name_lower"), "e.version", "ord")
        for i, name in enumerate(PRECEDENCE)
    ]
    return reduce(DataFrame.unionByName, parts)


def locked_versions(entries: DataFrame) -> DataFrame:
    """name_lower, version: a name's first entry in each lockfile, then the first lockfile whose entry has a version."""
    first = entries.groupBy("name_lower", "priority").agg(F.min_by(F.nullif("version", F.lit("")), "ord").alias("version"))
    return first.where("version is not null").groupBy("name_lower").agg(F.min_by("version", "priority").alias("version"))
