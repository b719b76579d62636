import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import admission as A
from attesta.operators import gate as G
from attesta.operators import skew
from attesta.functions import urls as U

NOW = dt.datetime(2026, 8, 29)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_origin_and_allow_list(spark, rows):
    origins = frame(spark, [("a", "https://a.org"), ("b", "https://b.org")],
                    "site string, origin string")
    urls = frame(spark, [("https://a.org/x",), ("http://b.org/",), ("ftp://a.org/x",),
                         ("https://evil.org/a.org",), ("nonsense",)], "url string")
    got = dict(rows(A.with_origin(urls, origins), "url", "site"))
    assert got == {"https://a.org/x": "a", "http://b.org/": "b", "ftp://a.org/x": "a",
                   "https://evil.org/a.org": None, "nonsense": None}
    kept, refused = A.split_allowed(urls, origins)
    assert rows(kept, "url") == [("http://b.org/",), ("https://a.org/x",)]
    assert refused.count() == 3


def test_exclusion_is_anchored_and_the_first_pattern_names_the_hit(spark, rows):
    patterns = frame(spark, [("https://a.org/x/*", 1), ("*", 9), ("https://a.org/x/y", 0),
                             ("https://b.org/q?z=(1)", 2)], "pattern string, ord int")
    urls = frame(spark, [("https://a.org/x/y",), ("https://a.org/x/z",), ("https://b.org/q?z=(1)",),
                         ("https://a.org/x",)], "url string")
    assert dict(rows(A.match_excluded(urls, patterns), "url", "excluded_by")) == {
        "https://a.org/x/y": "https://a.org/x/y", "https://a.org/x/z": "https://a.org/x/*",
        "https://b.org/q?z=(1)": "https://b.org/q?z=(1)", "https://a.org/x": "*"}
    none = A.match_excluded(urls, patterns.filter("ord < 2"))
    assert dict(rows(none, "url", "excluded_by"))["https://a.org/x"] is None


BODY = """# comment
User-agent: Googlebot
User-agent: ArchiveBot
Disallow: /private  # trailing

User-agent: *
Content-Signal: search=yes, ai-train=no
Allow: /
Disallow: /admin
Disallow: /*.pdf$

User-agent: *
Disallow: /tmp
Crawl-delay: 2.5
Disallow:
"""


@pytest.fixture
def decide(spark):
    def run(body, url, agent="CatalogBot"):
        rules = A.robots_rules(frame(spark, [("h.org", body)], "host string, body string"))
        urls = frame(spark, [(f"https://h.org{url}",)], "url string")
        row = A.robots_decisions(urls, rules, agent).first()
        return row.allowed, row.rule, row.crawl_delay
    return run


@pytest.mark.parametrize("url, agent, expected", [
    ("/x", "CatalogBot", (True, "/", 2.5)),
    ("/admin/x", "CatalogBot", (False, "/admin", 2.5)),
    ("/tmp", "CatalogBot", (False, "/tmp", 2.5)),
    ("/a/b.pdf", "CatalogBot", (False, "/*.pdf$", 2.5)),
    ("/a/b.pdf?v=1", "CatalogBot", (True, "/", 2.5)),
    ("/private/x", "Googlebot-Image", (False, "/private", None)),
    ("/admin", "googlebot", (True, None, None)),
])
def test_robots_longest_rule_and_merged_groups(decide, url, agent, expected):
    assert decide(BODY, url, agent) == expected


def test_robots_tie_goes_to_allow_and_html_counts_as_absent(decide):
    assert decide("User-agent: *\nDisallow: /x\nAllow: /x\n", "/x/y")[0] is True
    assert decide("<!DOCTYPE html><html>404</html>", "/x") == (True, None, None)
    assert decide("Disallow: /\n", "/x") == (True, None, None)
    assert decide("User-agent: other\nDisallow: /\n", "/x")[0] is True


def test_signal_drift_and_baseline(spark, rows):
    def signals(pairs):
        df = frame(spark, pairs, "host string, text string")
        return df.select("host", U.signal_map(F.col("text")).alias("signal"))
    before = signals([("a", "search=yes,use=ref"), ("b", "search=yes"), ("c", "x=1")])
    after = signals([("a", "search=no,use=ref,ai-input=no"), ("b", "search=yes"), ("new", "q=1")])
    drift = A.signal_drift(before, after)
    assert rows(drift, "host", "changed_keys") == [("a", ["ai-input", "search"]), ("c", ["x"])]


def test_intervals_and_overdue(spark, rows):
    src = frame(spark, [
        ("s1", ["announcement"], "crawl", NOW - dt.timedelta(hours=13)),
        ("s2", ["program"], "crawl", NOW - dt.timedelta(days=364)),
        ("s3", ["campus"], "manual", NOW - dt.timedelta(days=121)),
        ("s4", [], "crawl", NOW - dt.timedelta(days=9))],
        "source_id string, entity_types array<string>, method string, last_fetch_at timestamp")
    timed = A.with_interval(src)
    assert rows(timed, "source_id", "recrawl_hours") == [
        ("s1", 6), ("s2", 365 * 24), ("s3", 720), ("s4", 168)]
    assert rows(A.overdue_sources(timed, F.lit(NOW)), "source_id", "days_overdue", "alert") == [
        ("s1", 0, True), ("s3", 1, False), ("s4", 2, False)]
    assert dict(rows(A.source_report(timed, F.lit(NOW)), "source_id", "days_overdue")) == {
        "s1": 0, "s2": 0, "s3": 1, "s4": 2}


def test_budget_keeps_the_first_and_marks_the_rest(spark, rows):
    df = frame(spark, [("r1", i) for i in range(7)] + [("r2", 1)], "run_id string, n int")
    got = rows(A.apply_budget(df, ["n"], limit=5).filter("not admitted"), "run_id", "n", "error")
    assert got == [("r1", 5, "maxPagesPerRun (5) reached"), ("r1", 6, "maxPagesPerRun (5) reached")]


def test_fetch_outcomes(spark, rows):
    log = frame(spark, [("a", 1, 500), ("a", 2, 200), ("b", 1, 404), ("c", 1, 429), ("d", 1, 304),
                        ("e", 1, 503), ("e", 2, 503), ("e", 3, None)],
                "url string, attempt int, status int")
    assert rows(A.fetch_outcomes(log), "url", "attempts", "outcome", "retryable") == [
        ("a", 2, "fetched", False), ("b", 1, "failed", False), ("c", 1, "failed", True),
        ("d", 1, "unchanged", False), ("e", 3, "failed", True)]


def test_liveness_is_judged_by_content(spark, rows):
    big = "x" * 6000
    probes = frame(spark, [
        ("live", 200, "https://a.org/", big), ("small", 200, "https://a.org/", "x" * 5120),
        ("url", 200, "https://a.org/cgi-sys/suspendedpage.cgi", big),
        ("text", 200, "https://a.org/", big + " Account Suspended"),
        ("down", 503, "https://a.org/", big)],
        "id string, status int, final_url string, body string")
    assert dict(rows(A.probe_status(probes), "id", "source_status")) == {
        "live": "active", "small": "unavailable", "url": "suspended", "text": "suspended",
        "down": "unavailable"}


def test_gate_order_and_full_mode(spark, rows):
    fetched = frame(spark, [
        ("s1", "h1", None, True, 200), ("s2", "h2", None, True, 200), ("s3", "h3", "p*", False, 200),
        ("s4", "h4", None, False, 200), ("s5", "h5", None, True, 500), ("s6", None, None, True, 304)],
        "source_id string, content_hash string, excluded_by string, allowed boolean, http_status int")
    latest = frame(spark, [("s1", "h1"), ("s2", "old")], "source_id string, previous_hash string")
    assert dict(rows(G.gate(fetched, latest), "source_id", "gate")) == {
        "s1": "unchanged", "s2": "fetched", "s3": "excluded", "s4": "blocked", "s5": "failed",
        "s6": "unchanged"}
    assert dict(rows(G.gate(fetched, latest, "full"), "source_id", "gate"))["s1"] == "fetched"


def test_touch_leaves_failed_sources_alone(spark, rows):
    old = dt.datetime(2026, 1, 1)
    registry = frame(spark, [(s, "active", old, old, 200, True) for s in "abcd"],
                     "source_id string, status string, last_fetch_at timestamp, "
                     "last_change_at timestamp, last_status_code int, crawl_enabled boolean")
    outcomes = frame(spark, [("a", "fetched", 200), ("b", "unchanged", 304), ("c", "failed", 500),
                             ("d", "blocked", None)],
                     "source_id string, gate string, http_status int")
    got = rows(G.touch_sources(registry, outcomes, F.lit(NOW)), "source_id", "status",
               "last_fetch_at", "last_change_at", "last_status_code", "crawl_enabled")
    assert got == [("a", "active", NOW, NOW, 200, True), ("b", "active", NOW, old, 304, True),
                   ("c", "active", old, old, 200, True), ("d", "blocked", old, old, 200, False)]


def test_verified_unchanged_resets_misses_but_not_status(spark, rows):
    ents = frame(spark, [("r1", "a", "unknown", 2), ("r2", "b", "unknown", 2)],
                 "ref string, source_id string, status string, miss_count int").withColumn(
        "last_verified_at", F.lit(dt.datetime(2026, 1, 1)))
    quiet = frame(spark, [("a",), ("a",)], "source_id string")
    got = rows(G.mark_verified(ents, quiet, F.lit(NOW)), "ref", "status", "miss_count")
    assert got == [("r1", "unknown", 0), ("r2", "unknown", 2)]


def test_source_upsert_keeps_status_and_interval(spark, rows):
    cols = "url string, origin string, domain string, site string, entity_types array<string>, " \
           "method string, recrawl_hours int"
    refs = frame(spark, [("u1", "o", "d", "s", ["program"], "crawl", 168),
                         ("u2", "o", "d", "s", ["program"], "crawl", 168)], cols)
    known = frame(spark, [("u1", "x", "x", "x", ["campus"], "seed", 6, "blocked"),
                          ("u3", "x", "x", "x", ["campus"], "seed", 6, "active")],
                  cols + ", status string")
    got = rows(G.upsert_sources(refs, known), "url", "origin", "method", "recrawl_hours", "status")
    assert got == [("u1", "o", "crawl", 6, "blocked"), ("u2", "o", "crawl", 168, "active"),
                   ("u3", "x", "seed", 6, "active")]


def test_previous_value_crosses_chunks_and_matches_a_plain_lag(spark, rows):
    data = [("hot", i, f"v{i // 3}") for i in range(100)] + [("cold", 50, "c"), ("cold", 7, None)]
    df = frame(spark, data, "k string, n int, v string")
    got = skew.previous_value(df, ["k"], ["n"], F.floor(F.col("n") / 10), "v", "before")
    plain = df.selectExpr("k", "n", "lag(v) OVER (PARTITION BY k ORDER BY n) AS before")
    assert rows(got, "k", "n", "before") == rows(plain)


def test_number_rows_is_a_total_order(spark, rows):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("n")).repartition(7)
    got = [r.row_no for r in skew.number_rows(df, ["n"]).orderBy("n").collect()]
    assert got == list(range(1000))
