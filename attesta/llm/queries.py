"""The queries of this package and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import (
    alignment, chat, decontaminate, langid, licences, lm, negatives, pieces, quality, repeats,
    secrets, simhash, warc,
)
from attesta.llm.common import crc_mod, table
from attesta.session import configure, work_path

RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    """Register a query under its function's name."""
    RUN[run.__name__] = lambda spark, sf_dir: run(configure(spark), sf_dir)
    return run


@query
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", crc_mod(F.col("doc_id"), 3) == 1)
    model = langid.fit(docs, ~F.col("held_out"))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (repeats.remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
            .drop("runs"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "fingerprint", "component_id"))


@query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations")).drop("place")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(table(spark, sf_dir, "documents"), model,
                         outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.find(table(spark, sf_dir, "documents")))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "warc")
    index = warc.write_bundles(table(spark, sf_dir, "pages"), root)
    return (warc.read_bundles(spark, root, index, with_payload=False)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query
def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"),
                           pieces.read_model(public_tokenizers.path("byte_bpe_50k.json")),
                           pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


SQL["op10_warc"] = """
WITH known AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (SELECT sha256(html) AS k, min(page_id) AS first FROM known GROUP BY 1),
digests AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, f.first
  FROM known JOIN firsts f ON f.k = sha256(html)),
digits AS (SELECT '0123456789abcdef' AS hexes, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         letters[1 + CAST((
           (strpos(hexes, hex[1 + (5 * i) // 4]) - 1) * 16
           + (strpos(hexes, coalesce(nullif(hex[2 + (5 * i) // 4], ''), '0')) - 1))
           // (1 << (3 - (5 * i) % 4)) % 32 AS INTEGER)]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM digests, digits
"""

SQL["op12_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                               ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
