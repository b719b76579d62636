"""Runs over literal rows: the scenarios a published table has to survive."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import lifecycle as L
from attesta.operators import reconcile as R
from attesta.plans import ingest
from attesta.sources import store

FIELDS = ["source_name", "majors", "status"]
TABLE = ("owner string, site string, slug string, source_name string, majors array<string>, "
         "status string, source_id string, first_seen_at timestamp, last_verified_at timestamp, "
         "confidence string, miss_count int")
INCOMING = ("owner string, site string, slug string, source_name string, majors array<string>, "
            "status string, source_id string, pos int")
EXPECT = "owner string, entity_type string, min_rows int, max_rows int"


def day(n):
    return F.lit(dt.datetime(2026, 8, n))


class Catalogue:
    """A published table that runs are applied to, one after the other."""

    def __init__(self, spark):
        self.spark, self.run_no = spark, 0
        self.table = spark.createDataFrame([], TABLE)

    def run(self, records, sources=None, expect=(), mode="incremental", name="source_name"):
        """`records`: (slug, name, majors, source)."""
        self.run_no += 1
        rows = [("a", "a", slug, text, majors, "active", source, i)
                for i, (slug, text, majors, source) in enumerate(records)]
        sources = {r[6] for r in rows} if sources is None else sources
        incoming = self.spark.createDataFrame(rows, INCOMING)
        parsed = self.spark.createDataFrame([(s,) for s in sources], "source_id string")
        plan = ingest.plan(
            incoming, self.table, parsed, self.spark.createDataFrame(list(expect), EXPECT),
            entity_type="program_offering", run_id=f"r{self.run_no}", now=day(self.run_no),
            fields=FIELDS, mode=mode, arrays=["majors"], name=name, settle=True)
        self.last = plan
        self.events = sorted((e.entity_ref, e.operation) for e in plan.events.collect())
        self.verdicts = plan.verdicts.collect()
        self.aliases = sorted(tuple(a) for a in plan.aliases.collect()) if plan.aliases else []
        self.table = self.spark.createDataFrame(plan.next_state.collect(), TABLE)
        return self

    def rows(self, *columns):
        return sorted((tuple(r) for r in self.table.select(*columns).collect()), key=repr)


@pytest.fixture
def catalogue(spark):
    return Catalogue(spark)


def batch(n, source="s1", start=0):
    return [(f"p{i}", f"Program {i}", [], source) for i in range(start, start + n)]


def test_first_run_creates_and_second_run_is_silent(catalogue):
    assert len(catalogue.run(batch(4)).events) == 4
    assert {r[0] for r in catalogue.rows("confidence")} == {"high"}
    assert catalogue.run(batch(4)).events == []
    assert {r[0].day for r in catalogue.rows("last_verified_at")} == {2}
    assert {r[0].day for r in catalogue.rows("first_seen_at")} == {1}


def test_update_carries_the_field_diff(catalogue):
    catalogue.run(batch(2))
    catalogue.run([("p0", "Program 0", ["m"], "s1"), ("p1", "Program 1", [], "s1")])
    event = catalogue.last.events.collect()[0]
    assert event.operation == "updated"
    assert event["diff"] == {"majors": ("[]", '["m"]')}


def test_three_misses_remove_but_never_delete(catalogue):
    catalogue.run(batch(13))
    seen = []
    for _ in range(4):
        catalogue.run(batch(12))
        seen.append((dict(catalogue.rows("slug", "status"))["p12"],
                     dict(catalogue.rows("slug", "miss_count"))["p12"], catalogue.events))
    assert [s[:2] for s in seen] == [("unknown", 1), ("unknown", 2), ("removed", 3), ("removed", 4)]
    assert [s[2] for s in seen] == [[("a/p12", "updated")], [], [("a/p12", "removed")], []]
    catalogue.run(batch(13))
    assert dict(catalogue.rows("slug", "status"))["p12"] == "active"
    assert catalogue.events == [("a/p12", "updated")]


def test_rows_of_sources_outside_the_run_are_untouched(catalogue):
    catalogue.run(batch(6, "A") + batch(6, "B", 6) + batch(20, "C", 12))
    catalogue.run(batch(6, "A") + batch(6, "B", 6))
    assert [v.action for v in catalogue.verdicts] == ["publish"]
    assert len(catalogue.rows("slug")) == 32
    assert {r for r in catalogue.rows("source_id", "miss_count")} == {("A", 0), ("B", 0), ("C", 0)}


def test_emptied_parse_is_quarantined_and_changes_nothing(catalogue, spark):
    catalogue.run(batch(12))
    before = catalogue.rows(*[c.split()[0] for c in TABLE.split(", ")])
    catalogue.run([], sources=["s1"], expect=[("a", "program_offering", 1, 50)])
    # Nothing was emitted at all, so no owner ran; an owner that ran is what the guard sees.
    assert catalogue.verdicts == []
    catalogue.run(batch(5))
    assert [v.reason for v in catalogue.verdicts] == [
        f"program_offering count dropped 12{R.ARROW}5 (>30%)"]
    payload = catalogue.last.quarantine_payload.collect()
    assert len(payload) == 5 and '"slug":"p0"' in payload[0].payload
    assert catalogue.events == []
    assert [r[2] for r in before] == [r[2] for r in catalogue.rows("owner", "site", "slug")]


@pytest.mark.parametrize("n, current, low, high, mode, action", [
    (7, 10, None, None, "full", "publish"), (6, 10, None, None, "full", "quarantine"),
    (20, 10, None, None, "full", "publish"), (21, 10, None, None, "full", "quarantine"),
    (1, 9, None, None, "full", "publish"), (30, 9, None, None, "full", "publish"),
    (0, 1, None, None, "full", "quarantine"), (0, 0, None, None, "full", "publish"),
    (5, 0, 5, 9, "full", "publish"), (9, 0, 5, 9, "full", "publish"),
    (4, 0, 5, 9, "full", "quarantine"), (10, 0, 5, 9, "full", "quarantine"),
    (4, 0, 5, 9, "incremental", "publish")])
def test_guard_edges(spark, n, current, low, high, mode, action):
    counts = spark.createDataFrame(
        [("a", "program", n, current, low, high)],
        "owner string, entity_type string, incoming_count long, current_count long, "
        "min_rows int, max_rows int")
    row = R.guard(counts, mode).first()
    assert row.action == action
    assert (row.skipped is not None) == (mode == "incremental" and low is not None)


def test_expected_types_reach_the_guard_even_when_nothing_was_emitted(spark, rows):
    emitted = spark.createDataFrame([("a", "program")], "owner string, entity_type string")
    none = spark.createDataFrame([], "owner string, entity_type string")
    current = spark.createDataFrame([("a", "program"), ("a", "office")],
                                    "owner string, entity_type string")
    expect = spark.createDataFrame([("a", "office", 1, 2), ("b", "office", 1, 2)], EXPECT)
    got = R.guard_inputs(none, emitted, current, expect)
    assert rows(got, "owner", "entity_type", "incoming_count", "current_count") == [
        ("a", "office", 0, 1), ("a", "program", 0, 1)]


def test_rename_keeps_the_row_and_leaves_an_alias(catalogue):
    catalogue.run([("bs-civil", "BS Civil", [], "s1")])
    catalogue.run([("bsce", "BS Civil", [], "s1")])
    assert catalogue.aliases == [("bs-civil", "bsce")]
    assert catalogue.rows("slug", "status", "miss_count") == [("bsce", "active", 0)]
    assert catalogue.rows("first_seen_at")[0][0].day == 1
    assert catalogue.events == [("bsce", "updated")]


def test_second_row_on_one_key_is_superseded(catalogue):
    catalogue.run([("x-one", "BET major in One", ["One"], "s1"),
                   ("x-two", "BET major in Two", ["Two"], "s1")])
    catalogue.run([("bet", "BET major in One", ["One"], "s1"),
                   ("bet", "BET major in Two", ["Two"], "s1")])
    assert catalogue.aliases == [("x-one", "bet"), ("x-two", "bet")]
    assert catalogue.rows("slug", "status") == [("bet", "active"), ("x-two", "removed")]
    assert dict(catalogue.rows("slug", "majors"))["bet"] == ["One", "Two"]
    assert ("x-two", "removed") in catalogue.events


def test_a_row_still_sighted_under_its_key_does_not_move(catalogue):
    catalogue.run([("one", "Same name", [], "s1")])
    catalogue.run([("one", "Same name", [], "s1"), ("two", "Same name", [], "s1")])
    assert catalogue.aliases == []
    assert catalogue.rows("slug") == [("one",), ("two",)]


def test_last_publisher_takes_the_row_over(catalogue):
    catalogue.run([("p", "P", [], "s1")], name=None)
    catalogue.run([("p", "P", [], "s2")], name=None)
    assert catalogue.events == [("a/p", "created")]
    assert catalogue.rows("slug", "source_id") == [("p", "s2")]
    assert catalogue.rows("first_seen_at")[0][0].day == 1


def test_diff_is_null_safe_and_arrays_compare_in_order(spark):
    schema = "k string, a string, b array<string>, m map<string,string>"
    cur = spark.createDataFrame([("1", None, ["x", "y"], {"p": "1", "q": "2"}),
                                 ("2", "v", ["x", "y"], None)], schema)
    new = spark.createDataFrame([("1", None, ["x", "y"], {"q": "2", "p": "1"}),
                                 ("2", None, ["y", "x"], {"p": "1"})], schema)
    got = {r.k: (r["class"], set(r["diff"] or {})) for r in R.reconcile(
        new, cur, ["k"], ["a", "b", "m"]).collect()}
    assert got == {"1": ("unchanged", set()), "2": ("updated", {"a", "b", "m"})}


def test_commit_writes_logs_before_the_table(spark, catalogue, tmp_path):
    catalogue.run(batch(3))
    root = str(tmp_path)
    assert ingest.commit(catalogue.last, root, "offerings") == 1
    assert store.read_version(spark, f"{root}/offerings").count() == 3
    assert spark.read.parquet(f"{root}/change_events").count() == 3
    assert ingest.commit(catalogue.last, root, "offerings") == 2
    assert store.read_version(spark, f"{root}/offerings", 1).count() == 3


def test_parents_are_published_first():
    seen = []

    def step(name):
        def run(done):
            seen.append((name, sorted(done)))
            return name
        return run
    ingest.publish_all({"office": step("office"), "program_offering": step("program_offering"),
                        "academic_unit": step("academic_unit")})
    assert seen == [("academic_unit", []), ("program_offering", ["academic_unit"]),
                    ("office", ["academic_unit", "program_offering"])]


def test_aliases_resolve_through_chains_and_cycles(spark, rows):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    extra = [("p", "n3"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self")]
    got = L.resolve_aliases(spark.createDataFrame(chain + extra, "old_ref string, new_ref string"))
    out = {r.old_ref: (r.final_ref, r.hops) for r in got.collect()}
    assert all(out[f"n{i}"] == ("n40", 40 - i) for i in range(40))
    assert out["p"] == ("n40", 38)
    assert all(out[k] == (None, None) for k in ("x", "y", "z", "self"))


def test_random_alias_forests_with_cycles(spark):
    import random
    for seed in range(4):
        rng = random.Random(seed)
        edges = {f"n{i}": f"n{rng.randrange(60)}" for i in range(60) if rng.random() < 0.8}

        def follow(ref):
            hops, seen = 0, set()
            while ref in edges:
                if ref in seen:
                    return None, None
                seen.add(ref)
                ref, hops = edges[ref], hops + 1
            return ref, hops

        got = L.resolve_aliases(spark.createDataFrame(list(edges.items()), "old_ref string, new_ref string"))
        assert {r.old_ref: (r.final_ref, r.hops) for r in got.collect()} == {
            ref: follow(ref) for ref in edges}


def test_no_aliases_resolve_to_none(spark):
    assert L.resolve_aliases(spark.createDataFrame([], "old_ref string, new_ref string")).count() == 0


def test_unit_tree(spark, rows):
    units = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("lone", None)],
                                  "ref string, parent_ref string")
    assert rows(L.unit_tree(units), "ref", "root", "depth", "children") == [
        ("a", "r", 1, 2), ("b", "r", 2, 0), ("c", "r", 2, 0), ("lone", "lone", 0, 0),
        ("r", "r", 0, 1)]


def test_upsert_aliases_last_write_wins(spark, rows):
    old = spark.createDataFrame([("a", "b"), ("c", "d")], "old_ref string, new_ref string")
    new = spark.createDataFrame([("a", "z")], "old_ref string, new_ref string")
    assert rows(L.upsert_aliases(old, new)) == [("a", "z"), ("c", "d")]


def test_retention_and_resume(spark, rows):
    events = spark.createDataFrame([(1, dt.datetime(2025, 8, 29)), (2, dt.datetime(2025, 8, 28))],
                                   "id int, occurred_at timestamp")
    now = F.lit(dt.datetime(2026, 8, 29))
    assert rows(L.retain(events, now), "id") == [(1,)]
    got = events.select("id", L.resume_status(F.col("occurred_at"), now).alias("s"))
    assert rows(got) == [(1, "ok"), (2, "expired")]


def test_state_as_of_replays_the_log(spark, rows):
    def change(to):
        return {k: (None, v) for k, v in to.items()}
    log = spark.createDataFrame([
        (1, dt.datetime(2026, 1, 1), "r", "created", change({"a": "1", "b": "1"})),
        (2, dt.datetime(2026, 1, 2), "r", "updated", change({"a": "2"})),
        (3, dt.datetime(2026, 1, 2), "r", "updated", change({"a": "3"})),
        (4, dt.datetime(2026, 1, 3), "r", "removed", change({"status": "removed"}))],
        "id long, occurred_at timestamp, entity_ref string, operation string, "
        "diff map<string,struct<from:string,to:string>>")
    assert rows(L.state_as_of(log, F.lit(dt.datetime(2026, 1, 2))), "field", "value") == [
        ("a", "3"), ("b", "1")]
    assert L.state_as_of(log, F.lit(dt.datetime(2026, 1, 4))).count() == 0


def test_identity_falls_back_to_the_slug_and_never_mixes(spark, rows):
    df = spark.createDataFrame([("a", "7", "x"), ("a", None, "7")],
                               "site string, source_key string, slug string")
    assert rows(R.with_key(df), "identity") == [("key/a/7",), ("slug/a/7",)]


def test_purge_drops_excluded_rows(spark, rows):
    ents = spark.createDataFrame([("1", "https://a.org/x/1"), ("2", "https://a.org/y")],
                                 "ref string, source_url string")
    patterns = spark.createDataFrame([("https://a.org/x/*", 0)], "pattern string, ord int")
    assert rows(L.purge(ents, patterns), "ref") == [("2",)]
