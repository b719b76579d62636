"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, pieces.

Every stage works on all rows its predecessor kept and returns the columns of documents; the
last returns the pieces. Rows are told apart by a hash of id and text, so ids that are null or
repeat do no harm; rows equal in both are copies and share every decision.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, near, pieces, quality, secrets
from attesta.llm.common import free_name, table
from attesta.session import configure, materialize

ORACLE_SQL = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    name = free_name(docs, "row_key")
    return docs.withColumn(name, F.xxhash64("doc_id", "text", F.octet_length("text"))), name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the quality rules go."""
    rows, key = _keyed(docs)
    judged = quality.judge(rows, table(spark, sf_dir, "labels"), keep=(key,))
    bad = judged.filter(~F.col("kept")).select(key).distinct()
    return rows.join(bad, key, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (SimHash over five-word shingles, links verified at similarity
    0.8 or more) the row with the smallest id stays."""
    rows, key = _keyed(docs)
    found = materialize(near.near_copies(rows, keep=(key,)), "pipeline-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key))
    winners = found.groupBy("root").agg(first.alias("w")).select(f"w.{key}")
    # Texts meet the decisions once; rows with one key are copies.
    return rows.join(winners, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    rows, key = _keyed(docs)
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), doc_id=key)
    return rows.join(leaks.select(F.col("doc_id").alias(key)).distinct(), key,
                     "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of ids and of the text they decode to."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs, model, keep=("doc_id", "lang", "source"),
                         outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", keep_good),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
