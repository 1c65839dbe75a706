"""The dependency audit: resolved packages, advisories and latest versions to a graded report and its health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.versions import severity

UNKNOWN = "unknown"
_NO_CVES = "array<struct<id:string,summary:string>>"
#: The health weight of each severity, in percent.
WEIGHTS = {"OK": 100, "LOW": 75, "MEDIUM": 50, "HIGH": 25, "UNPINNED": 25, "CRITICAL": 0}


def resolve(packages: DataFrame, locked: DataFrame) -> DataFrame:
    """packages with a version from the lockfiles where the manifest has none, and resolved_from."""
    joined = packages.where("trim(name) <> ''").withColumn("name_lower", F.lower("name")).join(locked.select("name_lower", F.col("version").alias("_locked")), "name_lower", "left")
    open_ = F.coalesce("version", F.lit(UNKNOWN)) == UNKNOWN
    found = open_ & F.col("_locked").isNotNull()
    return joined.select(
        *[c for c in packages.columns if c not in ("version", "pinned")],
        F.when(found, F.col("_locked")).otherwise(F.coalesce("version", F.lit(UNKNOWN))).alias("version"),
        (F.coalesce(F.col("pinned"), ~open_) | found).alias("pinned"),
        F.when(found, "lockfile").otherwise("manifest").alias("resolved_from"),
    )


def latest_versions(registry: DataFrame) -> DataFrame:
    """system, name, latest_version: the first default version, else the last."""
    latest = F.coalesce(F.min_by(F.when(F.col("is_default"), F.col("version")), F.when(F.col("is_default"), F.col("ord"))), F.max_by("version", "ord"))
    return registry.groupBy("system", "name").agg(latest.alias("latest_version"))


def report(packages: DataFrame, advisories: DataFrame, latest: DataFrame) -> DataFrame:
    """One graded row for each package. advisories: ecosystem, name, version, cves, rows of one key united first."""
    known = advisories.groupBy("ecosystem", "name", "version").agg(F.flatten(F.collect_list("cves")).alias("cves"))
    rows = packages.join(known, ["ecosystem", "name", "version"], "left").join(latest.withColumnRenamed("system", "ecosystem"), ["ecosystem", "name"], "left")
    grade = severity(F.col("version"), F.col("latest_version"), F.size(F.coalesce("cves", F.array().cast(_NO_CVES))), F.col("pinned"))
    rows = rows.withColumn("severity", grade)
    open_ = F.col("severity") == "UNPINNED"
    return rows.select(
        "file_path",
        "ecosystem",
        "name",
        F.when(open_, UNKNOWN).otherwise(F.col("version")).alias("current_version"),
        F.coalesce("latest_version", F.lit(UNKNOWN)).alias("latest_version"),
        "severity",
        (~open_).alias("pinned"),
        F.when(open_, "none").otherwise(F.col("resolved_from")).alias("resolved_from"),
        F.when(open_ | F.col("cves").isNull(), F.array().cast(_NO_CVES)).otherwise(F.col("cves")).alias("cves"),
    )


#: The order of severities in tables, the gravest first.
RANKS = {"CRITICAL": 50, "HIGH": 40, "UNPINNED": 35, "MEDIUM": 30, "LOW": 20}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))))[severity], F.lit(10))


def health_score(severity: Column, total: Column | None = None) -> Column:
    """Mean weight, cut to an integer; 100 for nothing: an aggregate."""
    total = F.count(F.lit(1)) if total is None else total
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[severity]
    return F.when(total == 0, 100).otherwise(F.floor(F.coalesce(F.sum(weight), F.lit(0)) / total))


def health(reported: DataFrame, total_packages: int | None = None) -> DataFrame:
    """health_score, total_packages and a zero-filled count of each severity, for the scanner's package count."""
    total = F.count(F.lit(1)) if total_packages is None else F.lit(total_packages)
    return reported.agg(
        health_score(F.col("severity"), total).cast("int").alias("health_score"),
        total.cast("int").alias("total_packages"),
        *(F.count_if(F.col("severity") == s).cast("int").alias(s.lower()) for s in WEIGHTS),
    )
