"""Queries that drain a table through a streaming job and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.hashing import content_hash
from attesta.plans import bindings as B
from attesta.plans import ingest
from attesta.plans.registry import query
from attesta.plans.state_queries import _MISSES_SQL, FIELDS
from attesta.session import work_path
from attesta.sources import store
from attesta.sources.schemas import TABLES
from attesta.streaming import jobs as S


def _stream(spark, sf, name):
    # A pattern that only this table matches: its path may be one file or a folder of parts.
    return S.read_stream(spark, f"{sf}/{name}.parque[t]", TABLES[name])


def _drain(spark, stream, label):
    out = work_path(spark, label)
    S.append_to(stream, out, work_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark, sf):
    return _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# A window is written once the watermark, the newest event less the delay, has passed its end.
_MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {late} FROM events)"


@query("stream_content_gate", f"""WITH {B.SNAPSHOTS_SQL}, h AS (SELECT snapshot_id, content_hash,
  lag(content_hash) OVER (PARTITION BY source_id ORDER BY fetched_at) AS previous_hash FROM snapshots)
SELECT snapshot_id FROM h WHERE content_hash IS DISTINCT FROM previous_hash""")
def stream_content_gate(spark, sf):
    stream = _stream(spark, sf, "documents").select(
        content_hash(F.split("text", "\n", 2)[0]).alias("source_id"),
        F.col("doc_id").alias("snapshot_id"), F.col("doc_id").alias("fetched_at"),
        content_hash(F.col("text")).alias("content_hash"))
    root = work_path(spark, "gate")
    S.each_batch(stream, S.content_gate_step(f"{root}/state", f"{root}/passed", B.delivery_chunk()),
                 f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/passed").select("snapshot_id")


@query("stream_upsert", f"""WITH {B.SIGHTINGS_SQL}, latest AS (SELECT * FROM sightings
  QUALIFY row_number() OVER (PARTITION BY site, slug ORDER BY seen_at DESC, pos DESC) = 1)
SELECT slug, status, band, 0 AS miss_count FROM latest WHERE entity_type = 'document'""")
def stream_upsert(spark, sf):
    sources = B.sources(spark, sf).select("source_id", "site")
    kind = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    stream = _stream(spark, sf, "orders").filter(kind).select(
        F.col("o_custkey").cast("string").alias("source_id"),
        F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key")).alias("pos"),
        B.pick(B.STATUS_BY_CODE, F.col("o_orderstatus")).alias("status"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("band"))

    def records(batch):
        # The newest delivery of a key speaks for the batch.
        newest = batch.groupBy("source_id").agg(F.max(F.struct("pos", "status", "band")).alias("_t")
                                                ).select("source_id", "_t.*")
        return newest.join(sources, "source_id").select(
            F.col("site").alias("owner"), "site",
            F.concat(F.col("source_id"), F.lit("-document")).alias("slug"), "status", "band",
            "source_id", "pos")

    def plan_batch(batch, table, run_id):
        coming = records(batch)
        none = spark.createDataFrame(
            [], "owner string, entity_type string, min_rows int, max_rows int")
        return ingest.plan(coming, table, coming.select("source_id").distinct(), none,
                           entity_type="document", run_id=run_id, now=B.now(), fields=FIELDS,
                           settle=True, partial=True)

    def empty(session):
        return B.published(session, sf).drop("entity_type", "entity_ref").limit(0)

    root = work_path(spark, "upsert")
    S.each_batch(stream, S.upsert_step(root, "entities", plan_batch, empty,
                                       newest=("source_id", "pos"), keys=("site", "slug"),
                                       keys_of=records),
                 f"{root}/checkpoint").awaitTermination()
    return store.read_version(spark, f"{root}/entities").select("slug", "status", "band",
                                                                "miss_count")


@query("stream_misses", f"""WITH {_MISSES_SQL} SELECT source_id, slug AS ref,
  CAST(last_run AS INTEGER) AS last_run, miss_count, CASE WHEN miss_count >= 3 THEN 'removed'
  WHEN miss_count >= 1 THEN 'unknown' ELSE 'active' END AS status FROM misses""")
def stream_misses(spark, sf):
    known = B.sources(spark, sf).select("source_id")
    stream = _stream(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("source_id"),
        F.concat_ws("-", "o_custkey", B.pick(B.ENTITY_BY_PRIORITY, F.col("o_orderpriority")))
        .alias("ref"), F.year("o_orderdate").alias("run_no"))
    root = work_path(spark, "misses")
    S.each_batch(stream, S.miss_counter_step(f"{root}/state"),
                 f"{root}/checkpoint").awaitTermination()
    return S.misses(store.read_version(spark, f"{root}/state")).join(known, "source_id",
                                                                     "left_semi")


@query("stream_change_feed", f"""SELECT event_id AS id, event_type AS entity_type FROM events
WHERE ts >= TIMESTAMP '2025-01-10' - INTERVAL 12 MONTH AND event_type = 'signup'""")
def stream_change_feed(spark, sf):
    feed = _events(spark, sf).select(F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"),
                                     F.col("event_type").alias("entity_type"))
    return _drain(spark, S.change_feed(feed, B.ts("2025-01-10"), "signup"), "feed").select(
        "id", "entity_type")


@query("stream_quota_minute", f"""WITH w AS (SELECT user_id AS key,
  unnest(range(0, 6)) AS k, time_bucket(INTERVAL 10 SECOND, ts) AS b FROM events)
SELECT {B.sql_day("b - INTERVAL 10 SECOND * k")} AS window_start, key, count(*) AS requests,
  count(*) > 1 AS over_limit FROM w
WHERE b - INTERVAL 10 SECOND * k + INTERVAL 1 MINUTE <= {_MARK.format(late="10 MINUTE")} GROUP BY 1, 2""")
def stream_quota_minute(spark, sf):
    requests = _events(spark, sf).select("ts", F.col("user_id").alias("key"))
    return _drain(spark, S.usage_quota(requests, "1 minute", "10 seconds", 1), "quota").withColumn(
        "window_start", B.day("window_start"))


@query("stream_quota_day", f"""SELECT {B.sql_day("date_trunc('day', ts)")} AS window_start,
  user_id AS key, count(*) AS requests, count(*) > 3 AS over_limit FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_MARK.format(late="10 MINUTE")} GROUP BY 1, 2""")
def stream_quota_day(spark, sf):
    requests = _events(spark, sf).select("ts", F.col("user_id").alias("key"))
    return _drain(spark, S.usage_quota(requests, "1 day", None, 3), "quota").withColumn(
        "window_start", B.day("window_start"))


@query("stream_run_metrics", f"""WITH r AS (SELECT ts, user_id AS adapter,
  {B.case(B.RUN_STATUS_BY_EVENT, "event_type")} AS status FROM events)
SELECT {B.sql_day("date_trunc('hour', ts)")} AS window_start, adapter,
  count(*) FILTER (status = 'ok') AS ok_runs, count(*) FILTER (status = 'quarantined') AS quarantined,
  count(*) FILTER (status = 'failed') AS failed, count(*) AS published FROM r
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_MARK.format(late="1 HOUR")} GROUP BY 1, 2""")
def stream_run_metrics(spark, sf):
    log = _events(spark, sf).select(
        "ts", F.col("user_id").alias("adapter"),
        B.pick(B.RUN_STATUS_BY_EVENT, F.col("event_type")).alias("status"),
        F.lit(1).cast("bigint").alias("published"))
    return _drain(spark, S.run_metrics(log), "metrics").withColumn(
        "window_start", B.day("window_start"))


@query("stream_intake", """SELECT DISTINCT user_id, event_type, props FROM events""")
def stream_intake(spark, sf):
    keys = ["user_id", "event_type", "props"]
    kept = S.idempotent_intake(_events(spark, sf), keys, late="40 days")
    return _drain(spark, kept.select(*keys), "intake")


@query("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w
    + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS starts FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts
    ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS source_id, {B.sql_day("min(ts)")} AS started_at, count(*) AS actions
FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 3 HOUR <= {_MARK.format(late="1 HOUR")}""")
def stream_sessions(spark, sf):
    activity = _events(spark, sf).select("ts", F.col("user_id").alias("source_id"))
    return _drain(spark, S.run_sessions(activity, "3 hours"), "sessions").select(
        "source_id", B.day("started_at").alias("started_at"), "actions")
