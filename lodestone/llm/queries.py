"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontamination, exact_dedup, language_id, lexical, line_dedup, mixing, near_dedup, packing, prefix_trie, sharding, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A conversation whose texts hold another template's control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chats(turns.unionByName(extra)))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(3) == 1
    model = language_id.train(docs, learn=~held_out)
    return language_id.predict(docs, model).withColumn("held_out", held_out)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"), 40)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def crc_mod(n: int) -> Column:
    """crc32 of the id as text, modulo n: the rule that holds rows out of training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents"), min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(4) == 2, threshold=0.3)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), group=5, heads=9)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_minhash_dedup, op3_language_id, op4_exact_dedup, op5_sharding, op6_decontamination, op7_packing, op8_line_dedup, op9_substring_dedup, op10_toxicity, op11_mixing, op12_prefix_trie, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": r"""
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
            e AS (
                SELECT *, length(text) + length(regexp_replace(text, '[^\[\]<>\\]', '', 'g')) AS n,
                       length(role) + length(regexp_replace(role, '[^\[\]<>\\]', '', 'g')) AS r,
                       role = lag(role) OVER w IS TRUE AS follows
                FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
                   sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
                   (7 + sum(n + CASE WHEN (role = lag_role) IS TRUE THEN 6 ELSE 14 + r END))::BIGINT AS formatted_chars
            FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS lag_role FROM e)
            GROUP BY conv_id""",
        "op2_minhash_dedup": r"""
            WITH RECURSIVE d AS (
                SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            s AS MATERIALIZED (
                SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+3], ' ')) AS g
                FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
            c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS MATERIALIZED (
                SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) q
                JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= 80 * (ca.n + cb.n - shared)),
            r AS (
                SELECT doc_id AS a, doc_id AS b FROM documents
                UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
            m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
            SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
            FROM d JOIN m ON m.a = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""",
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op6_decontamination": r"""
            WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
            b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
            bw AS (
                SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS s, least(len(w), 10) AS m
                FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
            ms AS (SELECT DISTINCT m FROM bw),
            dw AS (
                SELECT doc_id, i, m, array_to_string(w[i:i+m-1], ' ') AS s
                FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
            hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, s)),
            cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
            its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY doc_id)
            SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
                   sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
            FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
        "op8_line_dedup": r"""
            WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
            k AS (
                SELECT *, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END FOR t IN string_split_regex(line, '[\x20\x09-\x0D]+') IF t <> ''] AS w FROM l),
            s AS (SELECT *, len(w) AS n, array_to_string(w[1:3], ' ') AS lead, array_to_string(w, ' ') AS said FROM k WHERE len(w) > 0),
            c AS MATERIALIZED (SELECT * FROM s WHERE (n, lead) IN (SELECT (n, lead) FROM s GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 5)),
            d AS MATERIALIZED (SELECT n, lead, said, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM c GROUP BY n, lead, said),
            p AS (SELECT n, lead, said, docs, unnest(w) AS token, unnest(range(1, n + 1)) AS place FROM d),
            f AS (SELECT n, lead, place, token FROM p WHERE token <> '<*>' GROUP BY ALL HAVING sum(docs) >= 5),
            t AS (
                SELECT p.n, p.lead, p.said, string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE p.token END, ' ' ORDER BY p.place) AS template, count(f.token) AS constant
                FROM p LEFT JOIN f USING (n, lead, place, token) GROUP BY p.n, p.lead, p.said),
            r AS (SELECT c.doc_id, c.pos, t.template FROM c JOIN t ON t.said = c.said WHERE t.constant >= 0.6 * t.n),
            g AS (SELECT doc_id, list(pos) AS gone FROM r WHERE template IN (SELECT template FROM r GROUP BY template HAVING count(DISTINCT doc_id) >= 5) GROUP BY doc_id)
            SELECT q.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
                   sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string([x[1] FOR x IN list_zip(string_split(text, chr(10)), range(0, len(string_split(text, chr(10))))) IF NOT list_contains(gone, x[2])], chr(10)) END) AS kept_sha256
            FROM documents q LEFT JOIN g USING (doc_id)""",
        "op9_substring_dedup": r"""
            WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
            win AS (
                SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
            early AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM early),
            g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
            SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
                   sha256(CASE WHEN ps IS NULL THEN coalesce(array_to_string(w, ' '), '')
                          ELSE array_to_string([x[1] FOR x IN list_zip(w, range(1, len(w) + 1)) IF NOT list_contains(ps, x[2])], ' ') END) AS kept_sha256
            FROM d LEFT JOIN g USING (doc_id)""",
    "op11_mixing": r"""
            WITH d AS (
                SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS z, md5(coalesce(text, '')) AS digest,
                       coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size FROM documents),
            g AS (SELECT z, s, sum(size)::BIGINT AS own, row_number() OVER (ORDER BY z, s) AS rank FROM d GROUP BY z, s),
            w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * own AS cap, sum(own) OVER () AS total FROM g),
            o AS (
                SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
                       sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
            c AS (SELECT *, (total - spent)::DOUBLE * weight > cap::DOUBLE * rest AS capped FROM o),
            t AS MATERIALIZED (
                SELECT z, s, own, CASE WHEN capped THEN cap::DOUBLE ELSE
                       (weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()))::DOUBLE / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target FROM c),
            p AS MATERIALIZED (
                SELECT *, coalesce(sum(size) OVER b, 0)::BIGINT AS start, coalesce(sum(size + 1) OVER b, 0)::BIGINT // 4096 AS block
                FROM d WINDOW b AS (PARTITION BY z, s ORDER BY doc_id NULLS FIRST, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            k AS MATERIALIZED (SELECT z, s, block, sum(size)::BIGINT AS words, min(start) AS begins FROM p GROUP BY ALL),
            e AS (
                SELECT z, s, block, words, own, wanted, unnest(range(0, (wanted - 1) // own + 1)) AS epoch
                FROM k JOIN (SELECT *, floor(target + 0.5)::BIGINT AS wanted FROM t) USING (z, s) WHERE words > 0 AND wanted > 0),
            q AS (
                SELECT *, wanted - epoch * own AS rest,
                       coalesce(sum(words) OVER (PARTITION BY z, s, epoch ORDER BY md5(concat_ws(':', 0, epoch, s, block)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e),
            h AS MATERIALIZED (SELECT z, s, block, list(least(words, rest - before)::BIGINT) AS given FROM q WHERE before < rest GROUP BY z, s, block)
            SELECT doc_id, size, own AS source_size, target,
                   coalesce(list_sum([least(size, greatest(0, x - (start - begins))) FOR x IN given]), 0)::BIGINT AS taken
            FROM p JOIN t USING (z, s) JOIN k USING (z, s, block) LEFT JOIN h USING (z, s, block)""",
        "op12_prefix_trie": r"""
            WITH t AS (
                SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
                       substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS id
                FROM conversations WHERE conv_id IS NOT NULL),
            c AS MATERIALIZED (
                SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(bytes ORDER BY turn NULLS FIRST, id) AS bs,
                       (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(conv_id::VARCHAR))), lambda a, k:
                           xor((CASE WHEN k % 8 = 0 THEN xor(a, ascii(substr(conv_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE a END) >> 1,
                               3988292384 * ((CASE WHEN k % 8 = 0 THEN xor(a, ascii(substr(conv_id::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE a END) & 1)))) % 9)::BIGINT AS h
                FROM t GROUP BY conv_id),
            r AS MATERIALIZED (
                SELECT c.conv_id AS conv, list_concat(coalesce(b.ids, [])[1:c.h], c.ids[c.h + 1:]) AS ids, list_concat(coalesce(b.bs, [])[1:c.h], c.bs[c.h + 1:]) AS bs
                FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
            m AS MATERIALIZED (
                SELECT conv, d AS depth, array_to_string(ids[1:d], '') AS key, array_to_string(ids[1:d - 1], '') AS above, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes, d = len(ids) AS ends
                FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM r)),
            n AS MATERIALIZED (
                SELECT depth, key, any_value(above) AS above, min(conv) AS conv, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saved,
                       sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS said FROM m GROUP BY depth, key),
            k AS MATERIALIZED (SELECT depth - 1 AS depth, above AS key, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
            v AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k USING (depth, key)),
            s AS (
                SELECT m.depth, m.key, count(*) FILTER (v.children = 0) AS leaves, sum(v.saved) AS saved
                FROM v JOIN m ON m.conv = v.conv AND m.depth <= v.depth GROUP BY ALL)
            SELECT v.conv AS conv_id, v.depth, p.conv AS parent_conv_id, v.n AS n_convs, v.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, v.said AS ends_sha256
            FROM v JOIN s USING (depth, key) LEFT JOIN v p ON p.depth = v.depth - 1 AND p.key = v.above""",
        "op13_lexical_search": r"""
            WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
            b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
            s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
            q AS MATERIALIZED (SELECT DISTINCT item_id, unnest(w) AS t FROM b),
            p AS MATERIALIZED (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
            f AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, docs),
            i AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)) AS impact FROM p, s),
            r AS (SELECT item_id, doc_id, sum(weight * impact)::BIGINT AS score FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY ALL HAVING sum(weight * impact) > 0)
            SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r) WHERE rank <= 50""",
    }
