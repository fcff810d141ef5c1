"""The registered queries opN_<name> over whole tables, each a thin digest of its operator, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, pieces, quality, quotes, simhash, suffix_dedup, token_counts, webp, wrappers
from .common import read_table


def tokenizer_file(name: str) -> str:
    """WEBLOOM_TOKENIZERS names the folder of tokenizer files; else the public_tokenizers package holds them."""
    if folder := os.environ.get("WEBLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(read_table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(read_table(spark, sf_dir, "conversations"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mixing.taken_words(mixing.mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_point", "last_point")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.members(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_passage_words follows the contract's columns: words in passages of over 50 words that another document has too, shorter than 400 bytes or not."""
    return suffix_dedup.digests(read_table(spark, sf_dir, "documents"), passage_words=51)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.main_texts(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SPACES = r"[\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CASE WHEN trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')) = '' THEN 0
              ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g')), ' ')) END AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s
), w AS (
  SELECT *, CAST(CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, source_size * 2.0 AS cap FROM o
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM w
), f AS (
  SELECT level FROM l WHERE NOT (level * weight >= cap) ORDER BY cap / weight, n LIMIT 1
), t AS (
  SELECT source, n, source_size, CASE WHEN level * weight >= cap THEN cap ELSE (SELECT level FROM f) * weight END AS target FROM l
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d
), j AS (
  SELECT p.doc_id, p.size, p.start, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(floor(t.target) AS BIGINT) AS wanted, t.n, row_number() OVER () AS row
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT n, CAST(ceil(floor(target) / 2048.0) AS BIGINT) AS n_slots, CAST(coalesce(sum(CAST(ceil(floor(target) / 2048.0) AS BIGINT)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM t
), z AS (
  SELECT greatest(1, CASE WHEN sum(n_slots) > 1 THEN len(bin(CAST(sum(n_slots) AS BIGINT) - 1)) ELSE 1 END) AS m FROM q
), x AS (
  SELECT n, unnest(range(before, before + n_slots)) AS place FROM q
), v AS (
  SELECT n, CAST(list_sum(list_transform(range(m), lambda k: ((place >> k) & 1) << (m - 1 - k))) AS BIGINT) AS point FROM x, z
), r AS (
  SELECT n, point, row_number() OVER (PARTITION BY n ORDER BY point) - 1 AS block_no FROM v
), e AS (
  SELECT row, n, epoch * source_size + start AS a, least(wanted, epoch * source_size + start + size) AS b FROM j, (VALUES (0), (1)) AS passes(epoch) WHERE size > 0
), f2 AS (
  SELECT row, n, unnest(range(CAST(a // 2048 AS BIGINT), CAST((b - 1) // 2048 AS BIGINT) + 1)) AS block_no FROM e WHERE b > a
), s2 AS (
  SELECT row, min(point) AS first_point, max(point) AS last_point FROM f2 JOIN r USING (n, block_no) GROUP BY row
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, wanted - start)) + greatest(0, least(size, wanted - source_size - start)) AS BIGINT) AS taken, first_point, last_point
FROM j LEFT JOIN s2 ON j.row = s2.row
"""

OP7_SQL = rf"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g ON t.norm = g.norm
"""

QUERIES = {
    "op1_webp_media": op1_webp_media,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_token_counts": op4_token_counts,
    "op5_source_mixing": op5_source_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL = {"op5_source_mixing": OP5_SQL, "op7_exact_dedup": OP7_SQL}
