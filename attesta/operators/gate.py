"""Change gating: newest snapshots, hash gate, and what it does to the source registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.skew import previous_value


def latest_snapshot(snapshots: DataFrame, source: str = "source_id", order: str = "fetched_at",
                    tie: str = "snapshot_id") -> DataFrame:
    """Newest snapshot of every source, with its body.

    Spark keeps one row per source and task before the shuffle, so a source with very many
    snapshots sends one body per task and older bodies stay where they are.
    """
    newest_first = Window.partitionBy(source).orderBy(F.desc(order), F.desc(tie))
    return snapshots.withColumn("_n", F.row_number().over(newest_first)).filter(
        F.col("_n") == 1).drop("_n")


def latest_hash(snapshots: DataFrame, source: str = "source_id", order: str = "fetched_at",
                tie: str = "snapshot_id") -> DataFrame:
    newest = snapshots.groupBy(source).agg(F.max(F.struct(
        F.col(order).alias("at"), F.col(tie).alias("tie"), "content_hash")).alias("_top"))
    return newest.select(source, F.col("_top.content_hash").alias("previous_hash"))


def gate(fetched: DataFrame, latest: DataFrame, mode: str = "incremental",
         source: str = "source_id") -> DataFrame:
    """Sort every fetch into excluded, blocked, failed, unchanged or fetched.

    `fetched` may carry excluded_by, allowed and http_status; `latest` is (source,
    previous_hash). Full mode parses everything whatever its hash. The order of the tests is
    the order in which a crawl would meet them.
    """
    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in fetched.columns else default

    excluded = given("excluded_by", F.lit(None).cast("string")).isNotNull()
    blocked = ~given("allowed", F.lit(True))
    status = given("http_status", F.lit(200))
    same = F.coalesce(F.col("content_hash") == F.col("previous_hash"), F.lit(False))
    unchanged = (status == 304) | same if mode == "incremental" else status == 304
    gate_status = (F.when(excluded, "excluded").when(blocked, "blocked")
                   .when(status >= 400, "failed").when(unchanged, "unchanged")
                   .otherwise("fetched"))
    return fetched.join(latest, source, "left").withColumn("gate", gate_status)


def gate_history(snapshots: DataFrame, chunk: Column, source: str = "source_id",
                 order: str = "fetched_at") -> DataFrame:
    """Gate a whole delivery history at once: each snapshot against its predecessor."""
    seen = previous_value(snapshots, [source], [order], chunk, "content_hash", "previous_hash")
    return seen.withColumn("gate", F.when(
        F.col("content_hash") == F.col("previous_hash"), "unchanged").otherwise("fetched"))


def gate_counts(gated: DataFrame, owner: str = "owner") -> DataFrame:
    def counted(name: str) -> Column:
        return F.count_if(F.col("gate") == name).alias(name)
    return gated.groupBy(owner).agg(
        F.count(F.lit(1)).alias("discovered"),
        *[counted(n) for n in ("fetched", "unchanged", "failed", "excluded", "blocked")])


def mark_verified(entities: DataFrame, unchanged: DataFrame, now: Column,
                  source: str = "source_id") -> DataFrame:
    """Rows of verified-unchanged sources: fresh `last_verified_at`, no misses.

    `status` is left as it was; only a sighting in a parsed page may change it.
    """
    hit = unchanged.select(source).distinct().withColumn("_hit", F.lit(True))
    return (entities.join(hit, source, "left")
            .withColumn("last_verified_at", F.when(F.col("_hit"), now).otherwise(
                F.col("last_verified_at")))
            .withColumn("miss_count", F.when(F.col("_hit"), 0).otherwise(F.col("miss_count")))
            .drop("_hit"))


def upsert_sources(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """Insert new sources; refresh identity columns of known ones, keep the rest.

    `refs` and `sources` share (url, origin, domain, site, entity_types, method,
    recrawl_hours); `sources` also has status and the fetch facts.
    """
    identity = ["origin", "domain", "site", "entity_types", "method"]
    joined = refs.alias("r").join(sources.alias("s"), "url", "full_outer")
    columns = [F.col("url")]
    for name in sources.columns:
        if name == "url":
            continue
        if name in identity:
            known = F.when(F.col("r.method").isNull(), F.col(f"s.{name}")).otherwise(
                F.col(f"r.{name}"))
        elif name == "recrawl_hours":
            known = F.coalesce(f"s.{name}", f"r.{name}")
        elif name == "status":
            known = F.coalesce(F.col("s.status"), F.lit("active"))
        else:
            known = F.col(f"s.{name}")
        columns.append(known.alias(name))
    return joined.select(*columns)


def touch_sources(sources: DataFrame, outcomes: DataFrame, now: Column,
                  source: str = "source_id") -> DataFrame:
    """Fold fetch and robots facts back into the registry.

    Failed and excluded fetches leave a source untouched; a blocked one stops being crawled;
    only a changed body moves `last_change_at`.
    """
    facts = outcomes.select(source, "gate", F.col("http_status").alias("_code"))
    was = F.col("gate")
    looked = was.isin("fetched", "unchanged")
    return (sources.join(facts, source, "left")
            .withColumn("last_fetch_at", F.when(looked, now).otherwise(F.col("last_fetch_at")))
            .withColumn("last_change_at", F.when(was == "fetched", now).otherwise(
                F.col("last_change_at")))
            .withColumn("last_status_code", F.when(looked, F.col("_code")).otherwise(
                F.col("last_status_code")))
            .withColumn("status", F.when(was == "blocked", "blocked").when(looked, "active")
                        .otherwise(F.col("status")))
            .withColumn("crawl_enabled", F.when(was == "blocked", False).otherwise(
                F.col("crawl_enabled")))
            .drop("gate", "_code"))
