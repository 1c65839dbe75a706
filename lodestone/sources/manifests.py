"""Package manifests as rows: one table of (file_path, ecosystem, name, version, pinned, ord)."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Manifest file names and their ecosystems.
ECOSYSTEMS = {"requirements.txt": "pip", "pyproject.toml": "pip", "package.json": "npm", "go.mod": "go", "Cargo.toml": "cargo", "pom.xml": "maven"}
UNKNOWN = "unknown"
_REQUIREMENT = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?"
_SPECIFIER = r"^[A-Za-z0-9_.\-]+\s*(?:==|>=|<=|~=|>|<)\s*([0-9A-Za-z.\-+]+)"
_ENTRY = "array<struct<name:string,version:string>>"


def ecosystem(name: Column) -> Column:
    pairs = [x for k, v in ECOSYSTEMS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(UNKNOWN))


def requirement(line: Column) -> Column:
    """struct(name, version) of a requirement line; null where it names no package. Extras hide the version."""
    plain = F.trim(F.regexp_replace(line, "#.*$", ""))
    name = F.regexp_extract(plain, _REQUIREMENT, 1)
    version = F.coalesce(F.nullif(F.regexp_extract(plain, _SPECIFIER, 1), F.lit("")), F.lit(UNKNOWN))
    return F.when((plain != "") & ~plain.startswith("-") & (name != ""), F.struct(name.alias("name"), version.alias("version")))


def _parsed(parse: Callable[[str], list[tuple[str, str]]]):
    """parse as a vectorised function of contents; what it can't read has no rows."""

    @F.pandas_udf(_ENTRY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(content: str):
            try:
                return [{"name": n, "version": v} for n, v in parse(content)]
            except Exception:  # noqa: BLE001  a malformed manifest is an ordinary input
                return []

        for contents in batches:
            yield contents.map(one)

    return run


def pyproject_entries(content: str) -> list[tuple[str, str]]:
    """(requirement or name, version) of PEP 621 dependencies, then of Poetry's table without python."""
    data = tomllib.loads(content)
    out = [(line, "") for line in data.get("project", {}).get("dependencies", [])]
    for name, spec in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            version = spec.get("version", UNKNOWN) if isinstance(spec, dict) else str(spec)
            out.append((name, version.strip("^~*") or UNKNOWN))
    return out


def cargo_entries(content: str) -> list[tuple[str, str]]:
    return [(n, s.get("version", UNKNOWN) if isinstance(s, dict) else str(s)) for n, s in tomllib.loads(content).get("dependencies", {}).items()]


def pom_entries(content: str) -> list[tuple[str, str]]:
    """group:artifact and version of each dependency element that has all three, whatever its namespace."""
    out = []
    for node in ElementTree.fromstring(content).iter():
        if node.tag.rpartition("}")[2] == "dependency":
            own = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in node}
            if all(own.get(k) for k in ("groupId", "artifactId", "version")):
                out.append((f"{own['groupId']}:{own['artifactId']}", own["version"]))
    return out


def packages(files: DataFrame) -> DataFrame:
    """file_path, ecosystem, name, version, pinned, ord of all manifests among files (path, name, content)."""
    of = lambda name: files.where(F.col("name") == name)

    def rows(df: DataFrame, entries: Column) -> DataFrame:
        return df.select(F.col("path").alias("file_path"), ecosystem(F.col("name")).alias("ecosystem"), F.posexplode(entries).alias("ord", "e")).where("e is not null").select("file_path", "ecosystem", "e.name", "e.version", "ord")

    requirements = rows(of("requirements.txt"), F.transform(F.split("content", r"\R"), requirement))
    both = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    node = rows(of("package.json").withColumn("j", both), F.transform(F.concat(*(F.coalesce(F.map_entries(F.col("j")[k]), F.array().cast("array<struct<key:string,value:string>>")) for k in ("dependencies", "devDependencies"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"))))
    go = r"(?m)(?:require\s+|^|\t)([\w.\-/]+)\s+(v[0-9A-Za-z.\-+]+)"
    names, versions = (F.regexp_extract_all("content", F.lit(go), F.lit(i)) for i in (1, 2))
    modules = rows(of("go.mod"), F.zip_with(names, versions, lambda n, v: F.struct(n.alias("name"), v.alias("version"))))
    raw = rows(of("pyproject.toml"), _parsed(pyproject_entries)(F.col("content")))
    project = raw.withColumn("e", F.when(F.col("version") == "", requirement(F.col("name"))).otherwise(F.struct("name", "version"))).where("e is not null").select("file_path", "ecosystem", "e.name", "e.version", "ord")
    cargo = rows(of("Cargo.toml"), _parsed(cargo_entries)(F.col("content")))
    maven = rows(of("pom.xml"), _parsed(pom_entries)(F.col("content")))
    out = requirements
    for part in (node, modules, project, cargo, maven):
        out = out.unionByName(part)
    return out.select("file_path", "ecosystem", "name", F.coalesce("version", F.lit(UNKNOWN)).alias("version"), ((F.col("ecosystem") == "npm") | (F.coalesce("version", F.lit(UNKNOWN)) != UNKNOWN)).alias("pinned"), "ord")
