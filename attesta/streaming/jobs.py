"""Structured Streaming forms of the recurring jobs.

Sources are append-only tables; state lives in Spark's state store, or in a versioned table
when it must be readable between batches. Every job takes its checkpoint folder from the
caller, which must be shared storage on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta import constants as K
from attesta.operators import reconcile as R
from attesta.operators.skew import previous_value
from attesta.session import scratch
from attesta.sources import store


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None
                ) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Drain what is there into a Parquet table (append mode) and stop."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str
               ) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --- K1 content gate, K2 upsert, K3 miss counter -----------------------------------------

def content_gate_step(state_path: str, out_path: str, chunk: Column, order: str = "fetched_at"
                      ) -> Callable[[DataFrame, int], None]:
    """Pass changed bodies, drop re-deliveries of the last one, per source.

    Only (source, order, hash) is compared. Inside a batch a delivery meets its predecessor,
    by `chunk` ranges of the order so that no source needs one task; the first of a source
    meets the stored state, one row per source. A replayed batch writes
    the same rows again under its own batch number, so nothing is doubled.

    The state holds the newest delivery with its place. A delivery older than that passes
    unless its body is the newest one's; it never replaces the state. It is kept in buckets of
    sources: a batch reads and rewrites those of its own sources, and retires what it replaced.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = store.touched_buckets(batch, state_path, ["source_id"])
        before = store.read_version(spark, state_path, below=batch_id + 1, only=mine)
        if before is None:
            before = batch.select("source_id", F.struct(
                F.col(order).alias("at"), "snapshot_id", "content_hash").alias("last")).limit(0)
        known = before.select("source_id", F.col("last.content_hash").alias("last_hash"))
        seen = previous_value(batch, ["source_id"], [order, "snapshot_id"], chunk,
                              "content_hash", "_before").join(known, "source_id", "left")
        passed = seen.filter(~F.col("content_hash").eqNullSafe(
            F.coalesce("_before", "last_hash"))).drop("_before", "last_hash")
        passed.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        fresh = batch.select("source_id", F.struct(
            F.col(order).alias("at"), "snapshot_id", "content_hash").alias("last"))
        after = before.unionByName(fresh).groupBy("source_id").agg(F.max("last").alias("last"))
        store.write_version(after, state_path, version=batch_id + 1, keys=["source_id"], only=mine)
        store.retire(spark, state_path)
    return step


def upsert_step(root: str, table: str,
                plan_batch: Callable[[DataFrame, DataFrame, str], object],
                empty: Callable[[SparkSession], DataFrame],
                newest: tuple[str, str] | None = None, keys: Sequence[str] = (),
                keys_of: Callable[[DataFrame], DataFrame] | None = None
                ) -> Callable[[DataFrame, int], None]:
    """Run a publish plan per batch: validated records in, next table version out.

    With `newest`, a key and a place of the records, a record counts only if its place lies
    behind the last one that came with its key. With a plan for `partial` batches the table
    then does not depend on how the records are cut into batches or in which order they come.

    With `keys`, the table's keys, it is kept in buckets, and only those with a changed row are
    written. With `keys_of` as well, which gives the keys of a batch's records, only their buckets
    are read and planned over: right for partial batches, which leave all other rows alone.

    Version and run id follow the batch number, so a replayed batch starts from the state
    before it: rows are not aged twice and events are not doubled. Versions older than that and
    the batch's intermediate tables are deleted.
    """
    from attesta.plans.ingest import commit

    def fresh(batch: DataFrame, batch_id: int) -> DataFrame:
        """Records behind the last place of their key; the places move on."""
        key, place = newest
        path = f"{root}/{table}_places"
        mine = store.touched_buckets(batch, path, [key])
        places = batch.groupBy(key).agg(F.max(place).alias("_last"))
        before = store.read_version(batch.sparkSession, path, below=batch_id + 1, only=mine)
        if before is not None:
            batch = batch.join(before, key, "left").filter(F.coalesce(
                F.col(place) > F.col("_last"), F.col("_last").isNull())).drop("_last")
            places = places.unionByName(before).groupBy(key).agg(F.max("_last").alias("_last"))
        store.write_version(places, path, version=batch_id + 1, keys=[key], only=mine)
        return batch

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{root}/{table}"
        with scratch(spark):
            if newest:
                batch = fresh(batch, batch_id)
            mine = None if keys_of is None else store.touched_buckets(keys_of(batch), path, keys)
            current = store.read_version(spark, path, below=batch_id + 1, only=mine)
            run = plan_batch(batch, empty(spark) if current is None else current,
                             f"batch-{batch_id}")
            commit(run, root, table, version=batch_id + 1, keys=keys, only=mine)
        for name in (table, f"{table}_places"):
            store.retire(spark, f"{root}/{name}")
    return step


def miss_counter_step(state_path: str, keep_runs: int | None = None
                      ) -> Callable[[DataFrame, int], None]:
    """Misses per ref: runs that looked at the ref's source since its last sighting.

    A batch holds (source_id, ref, run_no). State is two small sets: the last sighting of each
    ref and the runs of each source. Both fold by max and distinct, so a ref or source with
    very many rows is combined before any shuffle; a replayed batch changes nothing. They are kept
    in buckets of sources, and a batch reads and rewrites those of its own sources.

    With `keep_runs`, at least one more than the misses that remove a ref, only the newest runs of
    a source are remembered, and a sighting before all of them counts as of the oldest: the counts
    of removed refs then stop there, all others and every status stay as they are.
    """
    if keep_runs is not None and keep_runs <= K.MISSES_TO_REMOVE:
        raise ValueError(f"at least {K.MISSES_TO_REMOVE + 1} runs are needed")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = store.touched_buckets(batch, state_path, ["source_id"])
        sightings = batch.groupBy("source_id", "ref").agg(F.max("run_no").alias("run_no"))
        looked = batch.groupBy("source_id", "run_no").agg(F.lit(None).cast("string").alias("ref"))
        rows = sightings.unionByName(looked)
        state = store.read_version(spark, state_path, below=batch_id + 1, only=mine)
        if state is not None:
            rows = rows.unionByName(state)
        seen = rows.filter(F.col("ref").isNotNull()).groupBy("source_id", "ref").agg(
            F.max("run_no").alias("run_no"))
        runs = rows.filter(F.col("ref").isNull()).select("source_id", "run_no", "ref").distinct()
        if keep_runs is not None:
            newest = Window.partitionBy("source_id").orderBy(F.desc("run_no"))
            runs = runs.withColumn("_place", F.row_number().over(newest)).filter(
                F.col("_place") <= keep_runs).drop("_place")
            oldest = runs.groupBy("source_id").agg(F.min("run_no").alias("_oldest"))
            seen = seen.join(oldest, "source_id").select(
                "source_id", "ref", F.greatest("run_no", "_oldest").alias("run_no"))
        store.write_version(seen.unionByName(runs), state_path, version=batch_id + 1,
                            keys=["source_id"], only=mine)
        store.retire(spark, state_path)
    return step


def misses(state: DataFrame) -> DataFrame:
    """(source_id, ref, last_run, miss_count, status) from the miss counter's state.

    The runs of each source are ranked once from the newest; a sighting's rank is its number
    of misses, so a source's runs never multiply its refs.
    """
    return misses_from(state.filter(F.col("ref").isNotNull()),
                       state.filter(F.col("ref").isNull()).select("source_id", "run_no"))


def misses_from(sightings: DataFrame, runs: DataFrame) -> DataFrame:
    newest_first = Window.partitionBy("source_id").orderBy(F.desc("run_no"))
    ranked = runs.select("source_id", "run_no").distinct().withColumn(
        "miss_count", F.row_number().over(newest_first) - 1)
    last = sightings.groupBy("source_id", "ref").agg(F.max("run_no").alias("run_no"))
    return last.join(ranked, ["source_id", "run_no"]).select(
        "source_id", "ref", F.col("run_no").alias("last_run"), "miss_count",
        R.status_for_misses(F.col("miss_count")).alias("status"))


# --- K4 to K8: state kept by Spark -------------------------------------------------------

def change_feed(events: DataFrame, now: Column, entity_type: str | None = None,
                months: int = K.RETENTION_MONTHS) -> DataFrame:
    kept = events.filter(F.col("occurred_at") >= now - F.make_ym_interval(
        F.lit(0), F.lit(months)))
    return kept if entity_type is None else kept.filter(F.col("entity_type") == entity_type)


# Usage limits per tier.
QUOTA = {"anonymous": (60, 1_000), "free": (600, 100_000)}


def usage_quota(requests: DataFrame, width: str, slide: str | None, limit: int,
                late: str = "10 minutes", key: str = "key", ts: str = "ts") -> DataFrame:
    """Requests per key per (sliding or tumbling) window, flagged when over the limit."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return requests.withWatermark(ts, late).groupBy(span, key).agg(
        F.count(F.lit(1)).alias("requests")).select(
        F.col("window.start").alias("window_start"), key, "requests",
        (F.col("requests") > limit).alias("over_limit"))


def run_metrics(log: DataFrame, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Runs, quarantines and published rows per adapter and hour; later rows are dropped."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), "adapter").agg(
        F.count_if(F.col("status") == "ok").alias("ok_runs"),
        F.count_if(F.col("status") == "quarantined").alias("quarantined"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("published").alias("published")).select(
        F.col("window.start").alias("window_start"), "adapter", "ok_runs", "quarantined",
        "failed", "published")


def idempotent_intake(deliveries: DataFrame, keys: list[str], late: str = "1 day",
                      ts: str = "ts") -> DataFrame:
    """Exact duplicate deliveries dropped while the first is within the watermark."""
    return deliveries.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_sessions(activity: DataFrame, gap: str = "30 minutes", late: str = "1 hour",
                 key: str = "source_id", ts: str = "ts") -> DataFrame:
    """Bursts of activity per source, closed by a gap."""
    return activity.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(
        F.count(F.lit(1)).alias("actions")).select(
        key, F.col("session_window.start").alias("started_at"),
        F.col("session_window.end").alias("finished_at"), "actions")
