"""Review of previewed changes: decisions by hunk and file, merged files, checks, providers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import diff
from lodestone.operators import relational as rel

#: A command for each marker file of a build system, in order.
CHECK_RULES = (
    ("Cargo.toml", "cargo", "cargo check"),
    ("go.mod", "go", "go build ./..."),
    ("pom.xml", "mvn", "mvn -q compile"),
    ("build.gradle", "gradle", "gradle compileJava"),
    ("tsconfig.json", "npx", "npx tsc --noEmit"),
    ("package.json", "npm", "npm run build"),
    ("pyproject.toml", "python", "python -m compileall"),
    ("requirements.txt", "python", "python -m compileall"),
    ("setup.py", "python", "python -m compileall"),
)


def file_decisions(hunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """session_id, relative_path, rejected (hunk ids), state of each file: decisions (session_id, relative_path,
    hunk_id, decision) on its hunks, pending where there is none."""
    joined = hunks.join(decisions, ["session_id", "relative_path", "hunk_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
    return joined.groupBy("session_id", "relative_path").agg(F.array_sort(F.collect_list(F.when(F.col("decision") == "rejected", F.col("hunk_id")))).alias("rejected"), rel.review_state(F.col("decision")).alias("state"))


def apply_decisions(files: DataFrame, decided: DataFrame) -> DataFrame:
    """session_id, relative_path, final_content, state: files (original, patched) with rejected hunks left out; a file
    without a decision, or with none accepted, stays as it was."""
    rows = files.join(decided, ["session_id", "relative_path"], "left")
    partly = diff.partial_apply("original", "patched", F.coalesce("rejected", F.array().cast("array<string>")))
    content = F.when(F.col("state") == "accepted", F.col("patched")).when(F.col("state") == "partial", partly).otherwise(F.col("original"))
    return rows.select("session_id", "relative_path", content.alias("final_content"), F.coalesce("state", F.lit("pending")).alias("state"))


def review_totals(decided: DataFrame) -> DataFrame:
    """Files of each state."""
    return rel.histogram(decided, [], "state", ("pending", "accepted", "rejected", "partial"))


def merge_sessions(files: DataFrame) -> DataFrame:
    """relative_path, content, sessions: the first session's file with the later ones' edits replayed in order."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        content = group["patched"].iloc[0]
        for original, patched in zip(group["original"].iloc[1:], group["patched"].iloc[1:], strict=True):
            content = diff.replay_delta(original, patched, content)
        return pd.DataFrame({"relative_path": [group["relative_path"].iloc[0]], "content": [content], "sessions": [len(group)]})

    return files.select("relative_path", "ord", "original", "patched").groupBy("relative_path").applyInPandas(fold, "relative_path string, content string, sessions long")


def overlay(originals: DataFrame, patched: DataFrame) -> DataFrame:
    """path, content with patched files over the original ones, new files included."""
    return originals.join(patched.select("path", F.col("content").alias("_p")), "path", "full_outer").select("path", F.coalesce("_p", "content").alias("content"))


def merged_hunks(hunks: DataFrame) -> DataFrame:
    """relative_path, additions, deletions, hunk_ids of a file over all sessions, in order of old lines."""
    return hunks.groupBy("relative_path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.transform(F.sort_array(F.collect_list(F.struct("old_start", "session_id", "hunk_id"))), lambda h: h["hunk_id"]).alias("hunk_ids"))


def gap_lines(hunks: DataFrame, file: str = "relative_path") -> DataFrame:
    """file, hunk_id, old_line, new_line of the unchanged lines before each hunk, numbered in both texts."""
    w = Window.partitionBy(file).orderBy("old_start")
    shift = rel.running_offset(hunks.withColumn("_d", F.col("new_lines") - F.col("old_lines")), [file], ["old_start"], "_d")
    rows = hunks.withColumn("_d", F.col("new_lines") - F.col("old_lines")).withColumn("_shift", shift).withColumn("_from", F.coalesce(F.lag(F.col("old_start") + F.col("old_lines")).over(w), F.lit(1)))
    gaps = rows.where("old_start > _from").select(file, "hunk_id", "_shift", F.explode(F.sequence("_from", F.col("old_start") - 1)).alias("old_line"))
    return gaps.select(file, "hunk_id", "old_line", (F.col("old_line") + F.col("_shift")).alias("new_line"))


def detected_checks(spark: SparkSession, project_files: DataFrame, commands: Sequence[str]) -> DataFrame:
    """ord, command, available: the checks that a project's marker files at its root call for, each command once."""
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(CHECK_RULES)], "ord int, path string, tool string, command string")
    hit = rules.join(project_files.select("path").distinct(), "path", "left_semi")
    return hit.groupBy("command").agg(F.min("ord").alias("ord"), F.min(F.col("tool").isin(*commands)).alias("available")).select("ord", "command", "available").orderBy("ord")


def check_summary(results: DataFrame) -> DataFrame:
    """status, checks, failed of all check results; skipped for none."""
    bad = F.col("status").isin("failed", "timeout")
    return results.agg(F.coalesce(rel.check_status(bad, F.col("status") == "skipped"), F.lit("skipped")).alias("s"), F.count(F.lit(1)).alias("checks"), F.count_if(bad).alias("failed")).select(F.when(F.col("checks") == 0, "skipped").otherwise(F.col("s")).alias("status"), "checks", "failed")


def provider_order(providers: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """name, priority of the enabled providers, in the wanted order, the others behind it by their own priority."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("name"))
    rank = F.struct((place == 0).alias("other"), place, "priority", "name")
    return providers.where("enabled").withColumn("_at", rank).withColumn("priority", F.row_number().over(Window.orderBy("_at"))).select("name", "priority")


def reconcile(packages: DataFrame, accepted: DataFrame) -> DataFrame:
    """packages with the current version that an accepted update (name, version) gave them."""
    return packages.join(accepted.select("name", F.col("version").alias("_v")), "name", "left").withColumn("current_version", F.coalesce("_v", "current_version")).drop("_v")


def repaired(replaced: DataFrame) -> DataFrame:
    """file, content, status: repaired files (content, replacements) with what could not be placed left out."""
    inside = F.size(F.filter("replacements", lambda r: (r["start_line"] >= 1) & (r["end_line"] >= r["start_line"]) & (r["end_line"] <= F.size(F.split("content", "\n")))))
    status = F.when(inside == 0, "failed").when(inside == F.size("replacements"), "success").otherwise("partial")
    return replaced.select("file", diff.splice(F.col("content"), F.col("replacements")).alias("content"), status.alias("status"))


def syntax_errors(files: DataFrame) -> DataFrame:
    """path, error of the Python files that don't parse."""
    import ast

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    ast.parse(content or "")
                except (SyntaxError, ValueError) as e:
                    rows.append((path, str(e)))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files.where(F.col("path").endswith(".py")).select("path", "content").mapInPandas(run, "path string, error string")
