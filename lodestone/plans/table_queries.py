"""Addresses, the parse cache and table functions on the analytical tables, each query with its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.operators import addresses, code_graph, parse_cache
from lodestone.sources.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in addresses.PAGE_SUFFIXES) + "]"
_SITE_SQL, _VERSION_SQL, _API_SQL = ("[" + ", ".join(f"'{s}'" for s in names) + "]" for names in (addresses.SITE_SUFFIXES, addresses.VERSION_SUFFIXES, addresses.API_SUFFIXES))


@query(rf"""
    WITH b AS (SELECT DISTINCT p_brand AS package, 'https://docs' || p_size % 3 || '.dev' AS base FROM part),
    s AS (SELECT p_brand AS package, lower(replace(p_type, ' ', '.')) AS symbol, min(p_partkey) AS ord FROM part GROUP BY ALL),
    x AS (SELECT package, base, symbol, ord, unnest({_SUFFIX_SQL}) AS t, unnest(range(0, {len(addresses.PAGE_SUFFIXES)})) AS j FROM b JOIN s USING (package)),
    u AS (
        SELECT package, base, ord, j, rtrim(base || '/' || replace(replace(replace(replace(t, '{{v}}', '1.2.0'), '{{api}}', symbol), '{{path}}', replace(symbol, '.', '/')), '{{slug}}', regexp_replace(regexp_extract(symbol, '([^.]*)$', 1), '[^0-9A-Za-z]+', '_', 'g')), '/') AS url FROM x),
    f AS (SELECT package, url, min((base, ord, j)) AS k0 FROM u GROUP BY ALL)
    SELECT package, place::INT AS place, url FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY k0) AS place FROM f) WHERE place <= 40""")
def q_old_pages(spark, sf_dir):
    """Brands as packages, sizes as documentation sites, types as APIs."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), "p_size", "p_type", "p_partkey")
    bases = part.select("package", F.concat(F.lit("https://docs"), F.col("p_size") % 3, F.lit(".dev")).alias("base")).distinct()
    symbols = part.groupBy("package", F.lower(F.replace("p_type", F.lit(" "), F.lit("."))).alias("symbol")).agg(F.min("p_partkey").alias("ord"))
    packages = part.select("package", F.lit("pip").alias("ecosystem"), F.lit("1.2.0").alias("version")).distinct()
    return addresses.old_pages(packages, bases, symbols, 40).select("package", "place", "url")


@query(rf"""
    WITH b AS (SELECT DISTINCT p_brand AS package, 'https://docs' || p_size % 3 || '.dev/' || p_size % 2 AS url, 'https://docs' || p_size % 3 || '.dev' AS base FROM part),
    v AS (SELECT p_brand AS package, (p_size % 4) || '.0' AS version, min(p_partkey) AS ord FROM part GROUP BY ALL),
    s AS (SELECT p_brand AS package, regexp_replace(lower(p_type), '[^0-9a-z]+', '_', 'g') AS slug, min(p_partkey) AS ord FROM part GROUP BY ALL),
    x AS (
        SELECT package, url, base, [0] AS k, url AS page FROM b
        UNION ALL SELECT package, url, base, [1, i], base || '/' || t FROM (SELECT *, unnest({_SITE_SQL}) AS t, unnest(range(0, {len(addresses.SITE_SUFFIXES)})) AS i FROM b)
        UNION ALL SELECT package, url, base, [2, ord, i], base || '/' || replace(t, '{{v}}', version) FROM (SELECT *, unnest({_VERSION_SQL}) AS t, unnest(range(0, {len(addresses.VERSION_SUFFIXES)})) AS i FROM b JOIN v USING (package))
        UNION ALL SELECT package, url, base, [3, ord, i], base || '/' || replace(t, '{{slug}}', slug) FROM (SELECT *, unnest({_API_SQL}) AS t, unnest(range(0, {len(addresses.API_SUFFIXES)})) AS i FROM b JOIN s USING (package))),
    f AS (SELECT package, rtrim(page, '/') AS url, min((url, k)) AS k0 FROM x GROUP BY 1, 2)
    SELECT package, place::INT AS place, url FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY k0) AS place FROM f) WHERE place <= 60""")
def q_site_pages(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), "p_type", "p_size", "p_partkey")
    base = F.concat(F.lit("https://docs"), F.col("p_size") % 3, F.lit(".dev"))
    urls = part.select("package", F.concat(base, F.lit("/"), F.col("p_size") % 2).alias("url"), base.alias("base")).distinct()
    versions = part.groupBy("package", F.concat(F.col("p_size") % 4, F.lit(".0")).alias("version")).agg(F.min("p_partkey").alias("ord"))
    symbols = part.groupBy("package", F.col("p_type").alias("symbol")).agg(F.min("p_partkey").alias("ord"))
    return addresses.site_pages(part.select("package").distinct(), urls, versions, symbols, 60).select("package", "place", "url")


@query(r"""
    SELECT 'doc' || doc_id AS path, len(list_filter(string_split_regex(text || CASE WHEN doc_id % 5 = 0 THEN ' one more' ELSE '' END, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_words
    FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL""")
def q_parse_cache(spark, sf_dir):
    """Documents as files: all are parsed once, then every seventh is gone and every fifth has changed."""
    text = table(spark, sf_dir, "documents").where("text is not null")
    files = text.select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.lit(1.0).alias("mtime"), F.col("text").alias("content"), "doc_id")
    changed = F.col("doc_id") % 5 == 0
    later = files.where("doc_id % 7 <> 0").withColumn("mtime", F.when(changed, 2.0).otherwise(1.0)).withColumn("content", F.when(changed, F.concat("content", F.lit(" one more"))).otherwise(F.col("content")))
    parse = lambda rows: rows.select("path", F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    folder = f"{shared_folder(spark)}/parse-cache-{uuid.uuid4().hex}"
    parse_cache.refresh(files, folder, 1, parse)
    return parse_cache.refresh(later, folder, 1, parse).select("path", "n_words")


@query(r"""
    WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
    p AS (
        SELECT conv_id, n, 0 AS chunk, turn AS first_pos, turn AS last_pos, text AS content FROM t WHERE n = 1
        UNION ALL SELECT q.conv_id, q.m, CASE WHEN fits THEN chunk ELSE chunk + 1 END, CASE WHEN fits THEN first_pos ELSE turn END, turn, CASE WHEN fits THEN content || chr(10) || chr(10) || text ELSE text END
        FROM (SELECT p.conv_id, p.chunk, p.first_pos, p.content, t.turn, t.text, t.n AS m, length(p.content) + 2 + length(t.text) <= 1200 AS fits FROM p JOIN t ON t.conv_id = p.conv_id AND t.n = p.n + 1) q)
    SELECT conv_id, chunk, arg_max(first_pos, n)::INT AS first_pos, arg_max(last_pos, n)::INT AS last_pos, arg_max(content, n) AS content FROM p GROUP BY conv_id, chunk""")
def q_packed_chunks(spark, sf_dir):
    """Turns as paragraphs of their conversations."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), "text")
    return tables.packed_chunks(turns, 1200).withColumnRenamed("key", "conv_id")


@query("""
    WITH n AS (SELECT conv_id || '-' || turn AS id, conv_id AS file, turn * 10 AS s, turn * 10 + 9 + (turn % 3) * 20 AS e FROM conversations),
    l AS (SELECT o_orderkey % 100 AS file, o_custkey % 90 AS line FROM orders)
    SELECT file, line, arg_min(id, (e - s, s, id)) AS node FROM l JOIN n USING (file) WHERE line BETWEEN s AND e GROUP BY file, line""")
def q_nodes_at(spark, sf_dir):
    """Turns as nested code nodes of their conversations, orders as places of an editor."""
    node = F.concat_ws("-", "conv_id", "turn")
    start = F.col("turn") * 10
    nodes = table(spark, sf_dir, "conversations").select(node.alias("id"), F.col("conv_id").alias("file"), start.alias("start_line"), (start + 9 + F.col("turn") % 3 * 20).alias("end_line"), F.lit("function").alias("context_type"))
    places = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("file"), (F.col("o_custkey") % 90).alias("line"))
    return code_graph.nodes_at(nodes, places)
