"""Sinks: content-addressed snapshots, append-only logs, replay; versioned tables by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.hashing import content_hash, storage_key
from attesta.operators.gate import latest_snapshot
from attesta.sources.versions import (  # noqa: F401
    current_version, read_version, retire, touched_buckets, write_version,
)


def with_storage_key(snapshots: DataFrame, owner: str = "owner", body: str = "body") -> DataFrame:
    hashed = snapshots.withColumn("content_hash", content_hash(F.col(body)))
    return hashed.withColumn("storage_key", storage_key(F.col(owner), F.col("content_hash")))


def store_snapshots(new: DataFrame, stored: DataFrame, body: str = "body") -> DataFrame:
    """Bodies to write: one per storage key, and only keys not stored yet.

    The key is checked before copies are dropped, on the digest alone; `first` picks any of
    the copies, which are equal by construction.
    """
    keyed = with_storage_key(new, body=body).join(
        stored.select("storage_key"), "storage_key", "left_anti")
    return keyed.groupBy("storage_key", "owner", "content_hash").agg(
        F.first(body).alias(body), F.count(F.lit(1)).alias("deliveries")).withColumn(
        "byte_size", F.octet_length(body))


def append_bodies(bodies: DataFrame, path: str) -> None:
    """Partitioned by owner and the first two hash digits, compressed by the codec."""
    (bodies.withColumn("prefix", F.substring("content_hash", 1, 2))
     .write.mode("append").partitionBy("owner", "prefix").option("compression", "zstd")
     .parquet(path))


def snapshot_log(snapshots: DataFrame, outcomes: DataFrame, key: str = "snapshot_id"
                 ) -> DataFrame:
    """Log rows with parse_status: pending until parsed, then ok, ok_with_warnings, failed.

    `outcomes`: (snapshot_id, warnings, parse_error), one row per parsed snapshot.
    """
    joined = snapshots.join(outcomes, key, "left")
    status = (F.when(F.col("parse_error").isNotNull(), "failed")
              .when(F.col("warnings").isNull(), "pending")
              .when(F.col("warnings") > 0, "ok_with_warnings").otherwise("ok"))
    return joined.withColumn("parse_status", status)


def write_log(rows: DataFrame, path: str, run_id: str) -> None:
    """A run's log rows in a folder of their own, so that a repeated run replaces them."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run_id}")


def run_summary(gate_counts: DataFrame, class_counts: DataFrame, quarantined: DataFrame,
                run_id: str, owner: str = "owner") -> DataFrame:
    """One row per owner: gate and publish counters, and the status of the run.

    The parsed sources are a table of their own (`run_sources`), as a run may touch any number
    of them.
    """
    held = quarantined.groupBy(owner).agg(F.count(F.lit(1)).alias("quarantined"))
    joined = gate_counts.join(class_counts, owner, "left").join(held, owner, "left").fillna(0)
    published = F.col("created") + F.col("updated") + F.col("unchanged")
    return joined.withColumn("run_id", F.lit(run_id)).withColumn(
        "published", published).withColumn("run_status", F.when(
            F.col("quarantined") > 0, "quarantined").otherwise("ok"))


def run_sources(gated: DataFrame, run_id: str, owner: str = "owner") -> DataFrame:
    """Sources actually parsed in the run."""
    return gated.filter(F.col("gate") == "fetched").select(
        F.lit(run_id).alias("run_id"), owner, "source_id").distinct()


def upsert_dimension(seed: DataFrame, current: DataFrame, keys: Sequence[str],
                     keep: Sequence[str] = (), check: Column | None = None) -> DataFrame:
    """Idempotent upsert of curated rows; columns in `keep` survive from the current row.

    `check` must hold for every seed row, else the job aborts and nothing is written.
    """
    keys = list(keys)
    if check is not None:
        # Tied to the key, so no optimizer rule may drop it.
        bad = F.raise_error(F.concat(F.lit("inconsistent seed row: "),
                                     F.concat_ws("/", *keys)))
        seed = seed.withColumn(keys[0], F.when(F.coalesce(check, F.lit(False)), F.col(keys[0]))
                               .otherwise(bad.cast(seed.schema[keys[0]].dataType)))
    columns = [c for c in current.columns if c not in keys]
    fresh = seed.select(*keys, F.struct(*[c for c in columns if c in seed.columns]).alias("n"))
    old = current.select(*keys, F.struct(*columns).alias("o"))
    joined = fresh.join(old, keys, "full_outer")

    def value(name: str) -> Column:
        if name not in seed.columns:
            return F.col(f"o.{name}")
        if name in keep:
            return F.when(F.col("o").isNotNull(), F.col(f"o.{name}")).otherwise(
                F.col(f"n.{name}"))
        return F.when(F.col("n").isNotNull(), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))

    return joined.select(*keys, *[value(c).alias(c) for c in columns])


def replay_set(snapshots: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Snapshots to parse again: the chosen ids, or the newest of every source."""
    if ids is not None:
        return snapshots.join(ids.select("snapshot_id"), "snapshot_id", "left_semi")
    return latest_snapshot(snapshots)


def parse_diff(then: DataFrame, now: DataFrame, keys: Sequence[str] = ("entity_type", "slug"),
               digest: str = "record_hash") -> DataFrame:
    """Two parses compared by key: added, removed, changed, same."""
    a = then.select(*keys, F.col(digest).alias("_then"))
    b = now.select(*keys, F.col(digest).alias("_now"))
    return a.join(b, list(keys), "full_outer").withColumn("change", F.when(
        F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed").when(
        F.col("_then") == F.col("_now"), "same").otherwise("changed")).drop("_then", "_now")


def snapshots_as_of(snapshots: DataFrame, at: Column) -> DataFrame:
    """The newest snapshot of every source at a time: what a rebuild parses again."""
    return latest_snapshot(snapshots.filter(F.col("fetched_at") <= at))
