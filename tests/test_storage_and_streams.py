import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from attesta.sources import scans, store
from attesta.sources.schemas import entity_schema
from attesta import constants as K
from attesta.streaming import jobs as S


def test_manifests_and_digests(spark, rows, tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    (folder / "good.html").write_bytes(b"good")
    (folder / "bad.html").write_bytes(b"edited")
    files = [{"file": f"{n}.html", "url": f"https://h/{n}", "collected_at": "2026-08-29T00:00:00Z",
              "sha256": hashlib.sha256(n.encode()).hexdigest(), "http_status": 200}
             for n in ("good", "bad", "gone")] + [{"file": "bad.html", "url": "https://h/none"}]
    (folder / "MANIFEST.json").write_text(json.dumps({"files": files}, indent=1))
    listed = scans.scan_manifests(spark, str(tmp_path))
    assert listed.count() == 4
    manifest = listed.select(F.regexp_replace(F.concat_ws("/", "folder", "file"), "^file:/+", "/")
                             .alias("path"), "sha256", "url")
    got = scans.verify_digests(manifest, scans.read_bodies(spark, str(tmp_path)))
    assert rows(got, "url", "verdict") == [("https://h/bad", "mismatch"), ("https://h/gone", "missing"),
                                           ("https://h/good", "ok"), ("https://h/none", "unrecorded")]
    assert scans.load_pages(spark, str(folder)).count() == 3


@pytest.mark.parametrize("entity_type", K.ENTITY_TYPES)
def test_every_entity_type_has_a_declared_schema(spark, tmp_path, entity_type):
    path = str(tmp_path / entity_type)
    spark.createDataFrame([], entity_schema(entity_type)).write.parquet(path)
    assert {"ref", "source_id", "confidence", "miss_count"} <= set(
        scans.load_entity(spark, path, entity_type).columns)


def test_each_distinct_body_is_stored_once(spark, rows, tmp_path):
    new = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")],
                                "owner string, body string")
    stored = store.with_storage_key(spark.createDataFrame([("a", "y")], "owner string, body string"))
    got = store.store_snapshots(new, stored)
    assert rows(got, "owner", "body", "deliveries", "byte_size") == [("a", "x", 2, 1), ("b", "x", 1, 1)]
    digest = hashlib.sha256(b"x").hexdigest()
    assert rows(got, "storage_key")[0][0] == f"a/{digest[:2]}/{digest}"
    store.append_bodies(got, str(tmp_path / "bodies"))
    assert spark.read.parquet(str(tmp_path / "bodies")).filter("owner = 'a'").count() == 1


def test_parse_status(spark, rows):
    snaps = spark.createDataFrame([(i,) for i in range(4)], "snapshot_id int")
    done = spark.createDataFrame([(1, 0, None), (2, 3, None), (3, 0, "boom")],
                                 "snapshot_id int, warnings int, parse_error string")
    assert rows(store.snapshot_log(snaps, done), "snapshot_id", "parse_status") == [
        (0, "pending"), (1, "ok"), (2, "ok_with_warnings"), (3, "failed")]


def test_dimension_upsert_is_idempotent_and_aborts_on_a_bad_row(spark, rows):
    schema = "slug string, name string, status string, first_seen string"
    current = spark.createDataFrame([("a", "A", "suspended", "2020"), ("z", "Z", "active", "2020")], schema)
    seed = spark.createDataFrame([("a", "A2", "active"), ("b", "B", "active")],
                                 "slug string, name string, status string")
    once = store.upsert_dimension(seed, current, ["slug"], keep=["status"])
    want = [("a", "A2", "suspended", "2020"), ("b", "B", "active", None), ("z", "Z", "active", "2020")]
    assert rows(once) == want
    assert rows(store.upsert_dimension(seed, once, ["slug"], keep=["status"])) == want
    with pytest.raises(Exception, match="inconsistent seed row: b"):
        store.upsert_dimension(seed, current, ["slug"], check=F.col("name") != "B").collect()


def test_replay_and_rebuild(spark, rows):
    snaps = spark.createDataFrame([("s", 1, dt.datetime(2026, 1, 1)), ("s", 2, dt.datetime(2026, 2, 1)),
                                   ("t", 3, dt.datetime(2026, 3, 1))],
                                  "source_id string, snapshot_id int, fetched_at timestamp")
    assert rows(store.replay_set(snaps), "snapshot_id") == [(2,), (3,)]
    ids = spark.createDataFrame([(1,)], "snapshot_id int")
    assert rows(store.replay_set(snaps, ids), "snapshot_id") == [(1,)]
    at = F.lit(dt.datetime(2026, 1, 15))
    assert rows(store.snapshots_as_of(snaps, at), "snapshot_id") == [(1,)]
    a = spark.createDataFrame([("p", "x", "1"), ("p", "y", "1"), ("p", "z", "1")],
                              "entity_type string, slug string, record_hash string")
    b = spark.createDataFrame([("p", "x", "1"), ("p", "y", "2"), ("p", "w", "1")],
                              "entity_type string, slug string, record_hash string")
    assert rows(store.parse_diff(a, b), "slug", "change") == [
        ("w", "added"), ("x", "same"), ("y", "changed"), ("z", "removed")]


# --- streams -----------------------------------------------------------------------------

class Feed:
    """A folder that batches are dropped into, drained by one streaming query at a time."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, str(root), schema

    def drop(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(
            f"{self.root}/in")

    def stream(self):
        return S.read_stream(self.spark, f"{self.root}/in", self.schema)


def test_content_gate_passes_changes_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path, "source_id string, snapshot_id long, fetched_at long, content_hash string")
    step = S.content_gate_step(f"{tmp_path}/state", f"{tmp_path}/out", F.floor(F.col("fetched_at") / 2))
    batches = [[("a", 1, 1, "h1"), ("a", 2, 2, "h1"), ("a", 3, 3, "h2"), ("b", 4, 4, "k")],
               [("a", 5, 5, "h2"), ("b", 6, 6, "k2")], [("b", 7, 7, "k"), ("a", 8, 8, "h2")]]
    for batch in batches:
        feed.drop(batch)
        S.each_batch(feed.stream(), step, f"{tmp_path}/cp").awaitTermination()
    passed = sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert passed == [1, 3, 4, 6, 7]
    # A batch delivered again after a failure writes the same rows.
    again = spark.createDataFrame(batches[2], feed.schema)
    step(again, 2)
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == passed


def test_a_replayed_upsert_batch_neither_ages_twice_nor_doubles_events(spark, rows, tmp_path):
    from attesta.plans import ingest
    schema = "owner string, site string, slug string, status string, source_id string, pos int"
    table = "owner string, site string, slug string, status string, source_id string, " \
            "first_seen_at timestamp, last_verified_at timestamp, confidence string, miss_count int"
    none = spark.createDataFrame([], "owner string, entity_type string, min_rows int, max_rows int")

    def plan_batch(batch, current, run_id):
        return ingest.plan(batch, current, batch.select("source_id").distinct(), none,
                           entity_type="program", run_id=run_id, fields=["status"],
                           now=F.lit(dt.datetime(2026, 1, 1)))

    step = S.upsert_step(str(tmp_path), "t", plan_batch, lambda s: s.createDataFrame([], table))
    first = spark.createDataFrame([("a", "a", x, "active", "s", 0) for x in "xy"], schema)
    second = spark.createDataFrame([("a", "a", "x", "active", "s", 0)], schema)
    step(first, 0)
    for _ in range(2):
        step(second, 1)
        state = store.read_version(spark, f"{tmp_path}/t")
        assert rows(state, "slug", "status", "miss_count") == [("x", "active", 0), ("y", "unknown", 1)]
        assert spark.read.parquet(f"{tmp_path}/change_events").count() == 3


def test_miss_counter_over_runs(spark, rows, tmp_path):
    feed = Feed(spark, tmp_path, "source_id string, ref string, run_no int")
    step = S.miss_counter_step(f"{tmp_path}/state")
    seen = []
    for run in range(1, 7):
        refs = [("s", "always", run), ("t", "other", 1)]
        if run in (1, 5):
            refs.append(("s", "gone", run))
        feed.drop(refs)
        S.each_batch(feed.stream(), step, f"{tmp_path}/cp").awaitTermination()
        state = {r.ref: (r.miss_count, r.status) for r in S.misses(
            store.read_version(spark, f"{tmp_path}/state")).collect()}
        seen.append(state["gone"])
        assert state["always"] == (0, "active") and state["other"] == (0, "active")
    assert seen == [(0, "active"), (1, "unknown"), (2, "unknown"), (3, "removed"), (0, "active"),
                    (1, "unknown")]


def test_late_rows_are_dropped_by_the_watermark(spark, rows, tmp_path):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    feed = Feed(spark, tmp_path, "ts timestamp, adapter string, status string, published long")
    out = f"{tmp_path}/out"
    for batch in ([(t(1), "a", "ok", 5), (t(1, 30), "a", "quarantined", 0)], [(t(6), "a", "ok", 1)],
                  [(t(1, 45), "a", "ok", 99), (t(9), "a", "failed", 0)]):
        feed.drop(batch)
        S.append_to(S.run_metrics(feed.stream()), out, f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(out), "window_start", "ok_runs", "quarantined", "published")
    assert got == [(t(1), 1, 1, 5), (t(6), 1, 0, 1)]


def test_duplicates_within_the_watermark_are_dropped(spark, rows, tmp_path):
    t = dt.datetime(2026, 1, 1, 1)
    feed = Feed(spark, tmp_path, "ts timestamp, source_id string, content_hash string")
    out = f"{tmp_path}/out"
    for batch in ([(t, "a", "h"), (t, "a", "h")], [(t, "a", "h"), (t, "a", "g")]):
        feed.drop(batch)
        kept = S.idempotent_intake(feed.stream(), ["source_id", "content_hash"])
        S.append_to(kept, out, f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(out), "source_id", "content_hash") == [("a", "g"), ("a", "h")]


def test_sessions_close_after_the_gap(spark, rows, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    feed = Feed(spark, tmp_path, "ts timestamp, source_id string")
    feed.drop([(t(0), "a"), (t(20), "a"), (t(60), "a"), (t(300), "b")])
    S.append_to(S.run_sessions(feed.stream()), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "started_at", "finished_at", "actions") == [
        (t(0), t(50), 2), (t(60), t(90), 1)]


def test_quota_flags_the_window_over_the_limit(spark, rows):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([(t(s), "k") for s in (0, 10, 55, 70)], "ts timestamp, key string")
    got = S.usage_quota(df, "1 minute", None, 2)
    assert rows(got, "window_start", "requests", "over_limit") == [(t(0), 3, True), (t(60), 1, False)]
    sliding = S.usage_quota(df, "1 minute", "10 seconds", 2)
    assert sliding.agg(F.max("requests")).first()[0] == 3


def test_change_feed_keeps_the_window(spark, rows):
    df = spark.createDataFrame([(1, "program", dt.datetime(2025, 8, 28)), (2, "program", dt.datetime(2026, 1, 1)),
                                (3, "office", dt.datetime(2026, 1, 1))],
                               "id int, entity_type string, occurred_at timestamp")
    now = F.lit(dt.datetime(2026, 8, 29))
    assert rows(S.change_feed(df, now, "program"), "id") == [(2,)]
