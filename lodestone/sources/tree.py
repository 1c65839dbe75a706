"""Source trees as tables: a Python data source that sees hidden files and names that start with an underscore."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that each kind of scan leaves out.
MANIFEST_IGNORED = (".git", "node_modules", "target", "dist", "build", "__pycache__", "venv", "env")
EXPLORER_IGNORED = (".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build")
MAX_FILE_BYTES = 2_000_000
_SCHEMA = "path string, name string, extension string, size bigint, mtime double, content string"


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: set[str], hidden: bool, most: int, files_each: int):
        self.root, self.ignored, self.hidden, self.most, self.files_each = root, ignored, hidden, most, files_each

    def partitions(self) -> list[InputPartition]:
        """Names are listed with the ignored directories pruned; contents are read in the tasks."""
        found = []
        for folder, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.ignored and (self.hidden or not d.startswith(".")))
            found += [os.path.join(folder, n) for n in sorted(names)]
        return [_Files(found[i : i + self.files_each]) for i in range(0, len(found), self.files_each)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name in partition.paths:
            path = Path(name)
            try:
                stat = path.stat()
                if stat.st_size > self.most:
                    continue
                data = path.read_bytes()
            except OSError:
                continue
            if b"\0" not in data[:2048]:
                yield path.relative_to(self.root).as_posix(), path.name, path.suffix.lower(), stat.st_size, stat.st_mtime, data.decode("utf-8", "ignore")


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("path", root).load()"""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _TreeReader(o["path"], set(filter(None, o.get("ignored", "").split(","))), o.get("hidden", "true") == "true", int(o.get("maxBytes", MAX_FILE_BYTES)), int(o.get("filesPerPartition", 500)))


def read_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = MANIFEST_IGNORED, hidden: bool = False) -> DataFrame:
    """path, name, extension, size, mtime, content of the text files under root."""
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).option("ignored", ",".join(ignored)).option("hidden", str(hidden).lower()).load()


#: Language by file extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".cs": "c_sharp", ".rb": "ruby", ".php": "php", ".kt": "kotlin", ".swift": "swift", ".scala": "scala",
}


def language(extension: Column) -> Column:
    pairs = [x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[F.lower(extension)]


def under_root(root: Column, path: Column) -> Column:
    """The path relative to root, null outside of it; `.` and `..` parts are resolved."""
    parts = F.filter(F.split(F.concat_ws("/", root, path), "/"), lambda p: (p != "") & (p != "."))
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    base = F.filter(F.split(root, "/"), lambda p: p != "")
    return F.when(F.slice(clean, 1, F.size(base)) == base, F.array_join(F.slice(clean, F.size(base) + 1, F.size(clean) + 1), "/"))


def folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """parent, name, is_folder for every folder and file: folders first, then by name."""
    parts = F.split(path, "/")
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), F.get(parts, n - 1).alias("name"), (n < F.size(parts)).alias("is_folder")))).alias("n"))
    return nodes.select("n.*").distinct().orderBy("parent", F.desc("is_folder"), "name")
