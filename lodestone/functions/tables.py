"""Table functions: rows of a group in order, with what is carried from one to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn


@udtf
class PackedChunks:
    """chunk, first_pos, last_pos, content: a document's paragraphs (key, pos, text) packed in order into chunks.

    A paragraph joins the open chunk while the chunk stays within `size` characters, or while a code fence is open in
    it; else it opens the next one. The function asks for its table by key and in order of pos itself, so it is called
    with a plain table: `SELECT * FROM packed_chunks(TABLE(paragraphs), 1800)`. A document's rows come one by one, and
    what is kept of them is the open chunk.
    """

    @staticmethod
    def analyze(paragraphs: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not paragraphs.isTable or not {"key", "pos", "text"} <= {f.name for f in paragraphs.dataType.fields}:
            raise ValueError("the first argument is a table with key, pos and text")
        key = next(f for f in paragraphs.dataType.fields if f.name == "key")
        schema = StructType().add("key", key.dataType).add("chunk", IntegerType()).add("first_pos", IntegerType()).add("last_pos", IntegerType()).add("content", StringType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("pos")], select=[SelectedColumn("key"), SelectedColumn("CAST(pos AS INT)", alias="pos"), SelectedColumn("text")])

    def __init__(self):
        self.key, self.parts, self.length, self.chunk, self.first, self.last, self.fences = None, [], 0, 0, None, None, 0

    def eval(self, row, size: int):
        text = row["text"] or ""
        if not text.strip():
            return
        self.key = row["key"]
        if self.parts and self.length + 2 + len(text) > size and self.fences % 2 == 0:
            yield self._done()
        if not self.parts:
            self.first, self.length, self.fences = row["pos"], -2, 0
        self.parts.append(text)
        self.length, self.last, self.fences = self.length + 2 + len(text), row["pos"], self.fences + text.count("```")

    def _done(self):
        out = (self.key, self.chunk, self.first, self.last, "\n\n".join(self.parts))
        self.parts, self.chunk = [], self.chunk + 1
        return out

    def terminate(self):
        if self.parts:
            yield self._done()


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to SQL."""
    spark.udtf.register("packed_chunks", PackedChunks)


def packed_chunks(paragraphs: DataFrame, size: int = 1800) -> DataFrame:
    """packed_chunks of a table with key, pos and text."""
    spark = paragraphs.sparkSession
    register_tables(spark)
    return spark.sql(f"SELECT * FROM packed_chunks(TABLE({{rows}}), {int(size)})", rows=paragraphs)
