"""One key, source or group of copies holds a third of all rows; results stay whole."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import admission as A
from attesta.operators import gate as G
from attesta.operators import lifecycle as L
from attesta.operators import match as M
from attesta.operators import reconcile as R
from attesta.sources import store

N = 3000


@pytest.fixture(scope="module")
def skewed():
    """(key, order, value): a third of the rows belong to `hot`."""
    rng = random.Random(1)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(900)}", i, f"v{rng.randrange(4)}")
            for i in range(N)]


def test_history_of_a_hot_source(spark, skewed, rows):
    df = spark.createDataFrame(skewed, "source_id string, fetched_at long, content_hash string")
    got = rows(G.gate_history(df, F.floor(F.col("fetched_at") / 100)), "fetched_at", "gate")
    last, want = {}, []
    for key, at, value in skewed:
        want.append((at, "unchanged" if last.get(key) == value else "fetched"))
        last[key] = value
    assert got == sorted(want, key=repr)


def test_newest_of_a_hot_source(spark, skewed, rows):
    df = spark.createDataFrame([(k, i, i) for k, i, _ in skewed],
                               "source_id string, snapshot_id long, fetched_at long")
    newest = {}
    for key, at, _ in skewed:
        newest[key] = max(at, newest.get(key, -1))
    assert dict(rows(G.latest_snapshot(df), "source_id", "snapshot_id")) == newest
    plan = G.latest_snapshot(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_budget_of_a_hot_run(spark, skewed):
    df = spark.createDataFrame([(k, i) for k, i, _ in skewed], "run_id string, n long")
    got = A.apply_budget(df, ["n"], limit=7)
    assert got.count() == N
    assert got.filter("admitted and run_id = 'hot'").count() == 7


def test_merging_a_hot_key(spark, skewed, rows):
    df = spark.createDataFrame([(k, i, [v, f"{v}x"]) for k, i, v in skewed],
                               "key string, pos long, majors array<string>")
    got = {r.key: (r.majors, r.merged_rows) for r in
           M.merge_by_key(df.withColumn("name", F.lit("n")), ["key"], ["pos"], ["majors"]).collect()}
    want = {}
    for key, _, value in skewed:
        items, n = want.get(key, ([], 0))
        want[key] = (items + [x for x in (value, f"{value}x") if x not in items], n + 1)
    assert got == want


def test_copies_of_one_name_resolve_like_one(spark, skewed):
    registry = spark.createDataFrame([("bsce", "Bachelor of Science in Civil Engineering", ["hot"], 1)],
                                     "slug string, name string, aliases array<string>, ord int")
    names = spark.createDataFrame([(i, k) for k, i, _ in skewed], "id long, name string")
    got = M.resolve_names(names, registry)
    assert got.count() == N
    assert got.filter("match_slug = 'bsce'").count() == N // 3


def test_copies_of_one_body_are_stored_once(spark, skewed, rows):
    df = spark.createDataFrame([("o", k) for k, _, _ in skewed], "owner string, body string")
    empty = spark.createDataFrame([], "storage_key string")
    got = dict(rows(store.store_snapshots(df, empty), "body", "deliveries"))
    assert got["hot"] == N // 3 and sum(got.values()) == N


def test_a_name_shared_by_a_third_of_the_rows_renames_one(spark, skewed, rows):
    current = spark.createDataFrame([(f"old{i:04d}", k) for k, i, _ in skewed],
                                    "slug string, source_name string")
    coming = spark.createDataFrame([("new", "hot", 1)], "slug string, source_name string, pos int")
    last = max(i for k, i, _ in skewed if k == "hot")
    assert rows(L.renames(coming, current)) == [(f"old{last:04d}", "new", "rename")]


def test_many_aliases_of_one_target(spark):
    star = [(f"a{i}", "hub") for i in range(800)] + [("hub", "end")]
    got = L.resolve_aliases(spark.createDataFrame(star, "old_ref string, new_ref string"))
    assert {r.final_ref for r in got.collect()} == {"end"}


def test_a_hot_owner_is_counted_and_its_payload_stays_rows(spark, skewed):
    incoming = spark.createDataFrame([(k, "program", i) for k, i, _ in skewed],
                                     "owner string, entity_type string, slug long")
    current = incoming.filter("owner = 'hot'").union(incoming.filter("owner = 'hot'")).union(
        incoming.filter("owner = 'hot'"))
    none = spark.createDataFrame([], "owner string, entity_type string, min_rows int, max_rows int")
    verdicts = R.guard(R.guard_inputs(incoming, incoming, current, none))
    batches, payload = R.quarantine_rows(verdicts, incoming, "r")
    assert [tuple(b)[1:3] + tuple(b)[4:] for b in batches.collect()] == [
        ("hot", "program", N // 3, N)]
    assert payload.count() == N // 3
