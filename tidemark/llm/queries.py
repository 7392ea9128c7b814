"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, exact_dedup, html_text, language_id, mixing, packing, sharding, simhash, suffix_dedup, url_filter
from tidemark.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shard(docs, 40, materialised=True).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_embedding_dedup, op3_simhash, op4_html_text, op5_mixing, op6_suffix_dedup, op7_url_filter, op8_packing, op9_language_id, op10_exact_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
            ), ok AS MATERIALIZED (
                SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
                    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
            ), links AS (
                SELECT a.r, b.r AS other FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
                WHERE list_cosine_similarity(a.e, b.e) >= 0.93
            ), reach AS (
                SELECT r, r AS to_r FROM v UNION SELECT reach.r, links.other FROM reach JOIN links ON links.r = reach.to_r
            ), lows AS (
                SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.to_r GROUP BY reach.r
            ), counts AS (SELECT r, count(*) AS n FROM links GROUP BY r)
            SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
            FROM v JOIN lows USING (r) LEFT JOIN counts USING (r)
        """,
        # For pages of the tables' shape, where the article element is the main text.
        "op4_html_text": """
            WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
            bare AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM body),
            decoded AS (
                SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
                    x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text FROM bare)
            SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM decoded
        """,
        "op6_suffix_dedup": """
            WITH w AS (
                SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
                FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
            ), placed AS (SELECT doc_id, r, ws, unnest(range(len(ws) - 49)) AS s FROM w),
            windows AS (SELECT doc_id, r, s, sha256(array_to_string(ws[s + 1:s + 50], ' ')) AS h FROM placed),
            shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
            hit AS (SELECT doc_id, r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 50, true)::INTEGER AS new FROM windows SEMI JOIN shared USING (h)),
            islands AS (SELECT doc_id, r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS island FROM hit)
            SELECT doc_id, min(s)::BIGINT AS start_word, (max(s) + 50)::BIGINT AS end_word, (max(s) + 50 - min(s))::BIGINT AS n_words FROM islands GROUP BY doc_id, r, island
        """,
        "op10_exact_dedup": """
            WITH t AS (
                SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
            ), g AS (
                SELECT norm, count(*) AS group_size, arg_min(doc_id, {'size': -length(text), 'doc_id': doc_id}) AS keep_id FROM t GROUP BY norm
            )
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
            FROM t JOIN g ON t.norm = g.norm
        """,
    }
