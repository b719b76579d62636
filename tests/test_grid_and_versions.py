"""Block grids, similar texts, filtered search, and tables in buckets."""

import datetime as dt
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta import session
from attesta.operators import admission as A
from attesta.operators import grid, similar
from attesta.operators import match as M
from attesta.operators import retrieval as R
from attesta.plans import ingest
from attesta.sources import scans, store, versions
from attesta.streaming import jobs as S


# --- block grid --------------------------------------------------------------------------

@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_every_pair_meets_once(spark, monkeypatch, rows):
    monkeypatch.setattr(grid, "BLOCK_ROWS", rows)

    def kernel(left, right):
        a, b = left.column("a").to_pylist(), right.column("b").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([x for x in a for _ in b], pa.int64()),
                                          pa.array(b * len(a), pa.string())], names=["a", "b"])

    left = spark.createDataFrame([(i,) for i in range(9)], "a long").repartition(3)
    right = spark.createDataFrame([(f"x{i}",) for i in range(7)], "b string").repartition(2)
    met = grid.meet(left, right, kernel, "a long, b string")
    assert sorted(map(tuple, met.collect())) == [(i, f"x{j}") for i in range(9) for j in range(7)]
    assert grid.meet(left.limit(0), right, kernel, "a long, b string").count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != str(grid.CELLS_AT_ONCE)


@pytest.mark.parametrize("left, right, cores", [(1, 1, 8), (1, 500, 8), (500, 1, 8), (7, 9, 400),
                                                (10_000, 200, 1000), (3, 100_000, 8), (0, 5, 8)])
def test_stripes_keep_cells_small_and_copies_few(left, right, cores):
    i, j = grid._stripes(left, right, cores)
    assert 1 <= i <= max(1, left) and 1 <= j <= max(1, right)
    if left and right:
        assert left * right / (i * j) <= 2 * grid.CELL_PAIRS + 1


# --- similar texts -----------------------------------------------------------------------

def gram_set(text):
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    return {p[i:i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("rows", [3, 4096])
def test_the_k_most_similar_keys_are_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(grid, "BLOCK_ROWS", rows)
    r = random.Random(6)
    syllables = "ba co de fi gu ha ko li mo nu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    names = [" ".join(word() for _ in range(r.randint(1, 5))) for _ in range(60)]
    entries = [(f"k{i % 40:02d}", n) for i, n in enumerate(names)]
    entries += [(f"s{i}", "same name") for i in range(9)] + [("n", None), ("e", "")]
    queries = names[:15] + [n + " " + word() for n in names[15:25]] + ["same name", "", None, "zz",
                                                                       "same name"]
    for threshold in (0.2, 0.45):
        want = set()
        for q in {q for q in queries if q}:
            best = {}
            for key, text in entries:
                s = similarity(gram_set(q), gram_set(text or ""))
                if s > threshold:
                    best[key] = max(best.get(key, 0), s)
            top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
            want |= {(q, k, round(s, 12), i) for i, (k, s) in enumerate(top, 1)}
        got = similar.most_similar(spark.createDataFrame([(q,) for q in queries], "text string"),
                                   spark.createDataFrame(entries, "key string, text string"), 3,
                                   threshold)
        assert {(x.text, x.key, round(x.score, 12), x.place) for x in got.collect()} == want


def test_suggestions_form_no_pairs_of_rows(spark):
    """Only kept rows leave a cell: no join in the plan has a trigram or a pair in it."""
    queries = spark.createDataFrame([("alpha beta",), ("gamma",)], "query string")
    entries = spark.createDataFrame([(f"s{i}", f"alpha {i}", "beta") for i in range(20)],
                                    "slug string, name string, alias string")
    found = M.did_you_mean(queries, entries, ["name", "alias"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and found.count() == 3


def test_settled_queries_stop_at_the_first_threshold():
    index = similar.GramIndex(pa.array([["a", "b", "c"], ["a", "b", "c", "d"], ["x"],
                                        ["a"] + [f"y{i}" for i in range(20)]]))
    codes, _ = index.codes(pa.array([["a", "b", "c", "d"]]))
    seen = []

    def enough(rows):
        seen.append(sorted(rows.tolist()))
        return len(rows) >= 2
    rows, scores = index.best(codes, 4, 0.01, enough)
    assert seen == [[0, 1]] and sorted(zip(rows.tolist(), scores.tolist())) == [(0, 0.75), (1, 1.0)]
    rows, _ = index.best(codes, 4, 0.01, lambda rows: False)
    assert sorted(rows.tolist()) == [0, 1, 3]


# --- search arms -------------------------------------------------------------------------

def test_filters_hold_inside_both_arms(spark):
    texts = {1: "red fox", 2: "red fox fox", 3: "red dog", 4: "red fox", 5: "red fox"}
    chunks = [(1, texts[1], "a", "low"), (2, texts[2], "b", "high"), (3, texts[3], "a", "high"),
              (4, texts[4], "a", "medium"), (5, texts[5], "a", None)]
    vectors = [(i, [1.0, i / 10]) for i in texts] + [(9, [1.0, 0.0])]
    got = R.hybrid_search(
        spark.createDataFrame([(7, "red fox", [1.0, 0.0]), (8, None, [0.0, 1.0]), (9, "fox", None)],
                              "query_id int, text string, vector array<double>"),
        spark.createDataFrame(chunks, "chunk_id int, content string, site string, confidence string"),
        spark.createDataFrame(vectors, "chunk_id int, vector array<double>"), 5,
        site="a", confidence="medium")
    rows = {(r.query_id, r.chunk_id): (r.lex_rank, r.vec_rank) for r in got.collect()}
    assert rows == {(7, 4): (1, 2), (7, 3): (None, 1), (8, 4): (None, 1), (8, 3): (None, 2),
                    (9, 4): (1, None)}


@pytest.mark.parametrize("rows", [2, 4096])
def test_a_word_in_every_chunk_is_answered_in_pieces(spark, monkeypatch, rows):
    monkeypatch.setattr(grid, "BLOCK_ROWS", rows)
    docs = {i: "the " * (1 + i % 3) + ("cat " if i % 4 == 0 else "") + "x " * (i % 5) for i in range(40)}
    n, avg = len(docs), np.mean([len(d.split()) for d in docs.values()])
    queries = {1: "the", 2: "the cat", 3: "cat cat the", 4: "nowhere the", 5: "", 6: "the"}

    def gain(term, words):
        df = sum(term in d.split() for d in docs.values())
        tf = words.count(term)
        return math.log(1 + (n - df + .5) / (df + .5)) * tf * 2.2 / (
            tf + 1.2 * (.25 + .75 * len(words) / avg))
    want = set()
    for q, text in queries.items():
        hits = [(-round(sum(gain(t, d.split()) for t in set(text.split())), 6), i)
                for i, d in docs.items() if text and set(text.split()) <= set(d.split())]
        want |= {(q, i, p) for p, (_, i) in enumerate(sorted(hits)[:6], 1)}
    got = R.lexical_topk(spark.createDataFrame(list(queries.items()), "query_id int, text string"),
                         spark.createDataFrame(list(docs.items()), "chunk_id int, content string"), 6)
    assert {(r.query_id, r.chunk_id, r.lex_rank) for r in got.collect()} == want


# --- tables in buckets -------------------------------------------------------------------

def folders(path):
    return sorted(os.path.relpath(os.path.join(d, b), path) for d, bs, _ in os.walk(path)
                  for b in bs if b.startswith("_bucket"))


def test_only_touched_buckets_are_written_and_old_ones_go(spark, rows, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, v string"
    first = spark.createDataFrame([(i, "old") for i in range(300)], schema)
    assert versions.write_version(first, path, keys=["k"], buckets=16) == 1
    assert len(folders(path)) == 16
    change = spark.createDataFrame([(7, "new"), (1000, "more")], schema)
    mine = versions.touched_buckets(change, path, ["k"])
    assert 1 <= len(mine) <= 2
    before = versions.read_version(spark, path, only=mine)
    assert 0 < before.count() < 80
    after = before.join(change, "k", "left_anti").unionByName(change)
    assert versions.write_version(after, path, keys=["k"], only=mine) == 2
    assert [f for f in folders(path) if "v00000002" in f] == [
        f"data/v00000002/_bucket={b}" for b in sorted(mine, key=str)]
    want = sorted([(i, "new" if i == 7 else "old") for i in range(300)] + [(1000, "more")], key=repr)
    assert rows(versions.read_version(spark, path)) == want
    assert versions.read_version(spark, path, 1).filter("v = 'old'").count() == 300
    # Emptied buckets are empty, whatever they held before.
    versions.write_version(after.limit(0), path, keys=["k"], only=mine)
    left = versions.read_version(spark, path)
    assert left.filter(F.col("k").isin(7, 1000)).count() == 0
    assert left.count() == 300 - before.count()
    assert sorted(versions.retire(spark, path)) == [(1, b) for b in mine]
    assert len(folders(path)) == 16  # v1 lost the touched ones, v2 still has its own
    assert rows(versions.read_version(spark, path, 2)) == want
    versions.write_version(left, path, keys=["k"])
    versions.write_version(left, path, keys=["k"])
    assert {v for v, _ in versions.retire(spark, path)} == {1, 2}
    assert all("v00000004" in f or "v00000005" in f for f in folders(path))
    assert versions.retire(spark, path) == [] and versions.retire(spark, f"{tmp_path}/none") == []


def test_tables_without_keys_and_empty_tables(spark, rows, tmp_path):
    path = f"{tmp_path}/t"
    assert versions.read_version(spark, path) is None and versions.current_version(spark, path) is None
    none = spark.createDataFrame([], "a string, _b array<int>")
    assert versions.write_version(none, path) == 1
    assert versions.read_version(spark, path).schema == none.schema
    some = spark.createDataFrame([("x", [1]), (None, None)], none.schema)
    assert versions.write_version(some, path) == 2
    assert rows(versions.read_version(spark, path)) == [("x", [1]), (None, None)]
    assert versions.read_version(spark, path, 9) is None


def test_clustered_versions_hold_ranges_that_do_not_overlap(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(20_000).select(F.format_string("k%06d", (F.col("id") * 7919) % 20_000).alias("slug"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        versions.write_version(rows.repartition(3), path, cluster_by=["slug"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = sorted((r.low, r.high) for r in versions.read_version(spark, path).groupBy(
        F.input_file_name()).agg(F.min("slug").alias("low"), F.max("slug").alias("high")).collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_scratch_tables_go_with_their_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "work_root", lambda spark: str(tmp_path))
    with session.scratch(spark):
        inside = session.materialize(spark.range(3), "inside")
        with session.scratch(spark):
            session.materialize(inside, "deeper")
        assert inside.count() == 3 and len(os.listdir(tmp_path / "attesta")) == 1
    kept = session.materialize(spark.range(2), "kept")
    assert kept.count() == 2 and len(os.listdir(tmp_path / "attesta")) == 1


# --- captured pages ----------------------------------------------------------------------

def test_captured_pages_come_back_with_what_is_known_of_them(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 10)
    given = [("https://a/1", t, 200, "text/html", b"<p>one</p>"), ("https://a/1", t + dt.timedelta(hours=1), 304, None, b""),
             ("https://b/2", t, 404, "text/plain", None), ("https://b/\u00fc?x=1&y=/z", None, None, "a;b", b"\x00\xff")]
    schema = "url string, fetched_at timestamp, status int, content_type string, body binary"
    for root in (f"{tmp_path}/plain", f"file:{tmp_path}/scheme"):
        scans.capture_pages(spark.createDataFrame(given, schema).repartition(3), root)
        got = {(r.url, r.fetched_at): r for r in scans.load_captured(spark, root).collect()}
        assert len(got) == 4
        for url, at, status, kind, body in given:
            r = got[url, at]
            assert (r.status, r.content_type, bytes(r.body), r.byte_size, r.verdict) == (
                status, kind, body or b"", len(body or b""), "ok")
    files = sorted(p for p in (tmp_path / "plain").rglob("*.body") if p.stat().st_size)
    files[0].write_bytes(b"changed")
    files[1].unlink()
    (tmp_path / "plain" / "folder=0000" / "stray.body").parent.mkdir(exist_ok=True)
    (tmp_path / "plain" / "folder=0000" / "stray.body").write_bytes(b"no line names it")
    verdicts = sorted(r.verdict for r in scans.load_captured(spark, f"{tmp_path}/plain").collect())
    assert verdicts == ["mismatch", "missing", "ok", "ok"]


TABLE = ("owner string, site string, slug string, status string, source_id string, "
         "first_seen_at timestamp, last_verified_at timestamp, confidence string, miss_count int")
RECORDS = "owner string, site string, slug string, status string, source_id string, pos int"


def plan(spark, batch, current, run_id, **options):
    none = spark.createDataFrame([], "owner string, entity_type string, min_rows int, max_rows int")
    return ingest.plan(batch, current, batch.select("source_id").distinct(), none,
                       entity_type="program", run_id=run_id, fields=["status"],
                       now=F.lit(dt.datetime(2026, 1, 1)), **options)


def test_a_run_rewrites_the_buckets_of_its_sources_only(spark, rows, tmp_path):
    keys, root = ("site", "slug"), str(tmp_path)
    first = [("a", "a", f"s{i}", "active", f"src{i}", i) for i in range(200)]
    run = plan(spark, spark.createDataFrame(first, RECORDS), spark.createDataFrame([], TABLE), "r1")
    ingest.commit(run, root, "t", keys=keys)
    current = store.read_version(spark, f"{root}/t")
    second = [("a", "a", "s3", "closed", "src3", 0), ("a", "a", "new", "active", "src4", 0)]
    run = plan(spark, spark.createDataFrame(second, RECORDS), current, "r2", partial=True)
    ingest.commit(run, root, "t", keys=keys)
    assert 1 <= len([f for f in folders(f"{root}/t") if "v00000002" in f]) <= 3
    state = store.read_version(spark, f"{root}/t")
    assert rows(state.filter("status = 'closed'"), "slug") == [("s3",)]
    assert state.count() == 201


def test_batches_read_and_write_their_own_buckets(spark, tmp_path):
    root, keys = str(tmp_path), ("site", "slug")
    read = []

    def plan_batch(batch, current, run_id):
        read.append(current.count())
        return plan(spark, batch, current, run_id, settle=True, partial=True)

    step = S.upsert_step(root, "t", plan_batch, lambda s: s.createDataFrame([], TABLE),
                         newest=("slug", "pos"), keys=keys, keys_of=lambda b: b.select(*keys))
    batches = [[("a", "a", f"s{i}", "active", f"src{i}", 0) for i in range(300)],
               [("a", "a", "s5", "closed", "src5", 1)], [("a", "a", "s5", "open", "src5", 2)],
               [("a", "a", "s5", "late", "src5", 1), ("a", "a", "s6", "closed", "src6", 1)]]
    for number, batch in enumerate(batches):
        step(spark.createDataFrame(batch, RECORDS), number)
    step(spark.createDataFrame(batches[-1], RECORDS), len(batches) - 1)  # delivered again
    state = {r.slug: r.status for r in store.read_version(spark, f"{root}/t").collect()}
    assert len(state) == 300 and (state["s5"], state["s6"], state["s7"]) == ("open", "closed", "active")
    assert read[0] == 0 and all(0 < n < 60 for n in read[1:])
    held = [f for f in folders(f"{root}/t") if "v00000001" in f]
    assert 0 < len(held) < versions.BUCKETS  # what the later batches replaced is gone


def test_gate_and_miss_state_touch_their_sources_only(spark, tmp_path):
    gate = S.content_gate_step(f"{tmp_path}/g", f"{tmp_path}/out", F.col("fetched_at"))
    schema = "source_id string, snapshot_id long, fetched_at long, content_hash string"
    gate(spark.createDataFrame([(f"s{i}", i, 1, "h") for i in range(500)], schema), 0)
    gate(spark.createDataFrame([("s1", 900, 2, "h"), ("s2", 901, 2, "k")], schema), 1)
    assert {r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()} == {901}
    assert len([f for f in folders(f"{tmp_path}/g") if "v00000002" in f]) <= 2
    assert store.read_version(spark, f"{tmp_path}/g").count() == 500


def test_forgotten_runs_change_no_status(spark, tmp_path):
    r = random.Random(1)
    steps = {name: S.miss_counter_step(f"{tmp_path}/{name}", keep)
             for name, keep in (("all", None), ("few", 4))}
    for batch in range(9):
        seen = [(f"s{i % 3}", f"r{i}", batch) for i in range(12) if r.random() < 0.4]
        seen += [(f"s{i}", "always", batch) for i in range(3)]
        for step in steps.values():
            step(spark.createDataFrame(seen, "source_id string, ref string, run_no int"), batch)
    full, few = ({(x.source_id, x.ref): (x.miss_count, x.status) for x in S.misses(
        store.read_version(spark, f"{tmp_path}/{name}")).collect()} for name in steps)
    assert {k: s for k, (_, s) in full.items()} == {k: s for k, (_, s) in few.items()}
    assert {k: min(n, 3) for k, (n, _) in full.items()} == {k: n for k, (n, _) in few.items()}
    state = store.read_version(spark, f"{tmp_path}/few").filter("ref IS NULL")
    assert state.groupBy("source_id").count().agg(F.max("count")).first()[0] == 4
    with pytest.raises(ValueError):
        S.miss_counter_step("x", 3)


# --- admission ---------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [3, 7, 100])
@pytest.mark.parametrize("pruned", [1, 1000])
def test_budgets_of_any_size_and_rows_without_a_run(spark, monkeypatch, limit, pruned):
    monkeypatch.setattr(A, "PRUNED_RANK", pruned)
    r = random.Random(4)
    rows = [(None if i % 5 == 0 else f"run{i % 3}", n, f"u{i}") for i, n in enumerate(r.sample(range(900), 60))]
    rows.append(("alone", 5, "one"))
    got = A.apply_budget(spark.createDataFrame(rows, "run_id string, n int, url string").repartition(4),
                         ["n", "url"], limit=limit).collect()
    want = set()
    for run in {x[0] for x in rows}:
        mine = sorted((n, u) for name, n, u in rows if name == run)
        want |= {(run, u, k < limit) for k, (_, u) in enumerate(mine)}
    assert {(x.run_id, x.url, x.admitted) for x in got} == want and len(got) == len(rows)
    assert all((x.error is None) == x.admitted for x in got)


def test_wildcard_hosts_are_found_by_fragments(spark):
    import fnmatch
    r = random.Random(7)
    urls = [f"https://{r.choice('abc')}.{r.choice(['site', 'other', 'x'])}.org/{r.choice(['login', 'a', 'news'])}"
            f"/{r.randint(0, 30)}{r.choice(['', '?next=logout', '.html'])}" for _ in range(200)] + [None, "", "a", "https://"]
    patterns = ["https://a.site.org/login/*", "*logout*", "https://*.other.org/news/*", "*", "https://*/a/1*", "*x*z*",
                "http*://b.*.org/*.html", "https://c.site.org/a/3"] + [f"https://*.unseen{i}.net/*" for i in range(300)]
    for chosen in (patterns, patterns[:3] + patterns[4:], patterns[8:], []):
        order = list(chosen)
        r.shuffle(order)
        frame = spark.createDataFrame(list(zip(order, range(len(order)))), "pattern string, ord int")
        got = A.match_excluded(spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, i int"), frame)
        assert got.columns == ["url", "i", "excluded_by"]
        for x in got.collect():
            first = next((p for p in order if x.url is not None and fnmatch.fnmatchcase(
                x.url, p.replace("[", "[[]").replace("?", "[?]"))), None)
            assert x.excluded_by == first, (x.url, order[:9])
