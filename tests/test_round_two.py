"""Inputs that ordinary pages, folders of part files and unknown sources bring."""

import datetime as dt
import html
import os
import random
import re
import shutil
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attesta.functions import sql
from attesta.functions import text as X
from attesta.functions import urls as U
from attesta.operators import admission as A
from attesta.operators import extract as E
from attesta.operators import freshness
from attesta.plans import ingest
from attesta.sources import store
from attesta.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_links_are_resolved_against_the_page(spark):
    cases = [("http://h.x/a/b?q=1#f", "rel/y", "http://h.x/a/rel/y"), ("http://h.x/a/b", "../q", "http://h.x/q"),
             ("https://h.x/a/", "//o.x/z", "https://o.x/z"), ("http://h.x", "y", "http://h.x/y"),
             ("http://h.x/a", "/r/./s/../t", "http://h.x/r/t"), ("http://h.x/a", "?p=2", "http://h.x/a?p=2"),
             ("http://h.x/a", "mailto:a@b", None), ("http://h.x/a", "#top", None),
             ("http://h.x/a/b/c", "..", "http://h.x/a/"), ("http://h.x/", "../../up", "http://h.x/up"),
             ("http://h.x/a", "HTTPS://k.x/q", "HTTPS://k.x/q"), (None, "rel", None), ("http://h.x/a", None, None)]
    df = spark.createDataFrame(cases, "base string, href string, want string")
    for r in df.withColumn("got", U.resolve(F.col("base"), F.col("href"))).collect():
        assert r["got"] == r["want"], r


def test_end_tags_that_pages_leave_out():
    texts = lambda html, tag: [e.text() for e in E.parse_html(html).all(tag)]
    assert texts("<ul><li>A<li>B</ul>", "li") == ["A", "B"]
    assert texts("<ul><li>A<ul><li>a<li>b</ul><li>B</ul>", "li") == ["Aab", "a", "b", "B"]
    assert texts("<p>one<p>two<div>three</div>", "p") == ["one", "two"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>", "td") == ["1", "2", "3"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>", "tr") == ["12", "3"]
    assert texts("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "dd") == ["v", "w"]
    assert len(texts("<div>" * 5000 + "deep", "div")) == 5000


def test_an_unknown_source_keeps_its_row(spark):
    entities = spark.createDataFrame(
        [("document", "a", None, "high", "2026-01-01"), ("document", "b", "gone", "low", "2026-01-01")],
        "entity_type string, entity_ref string, source_id string, confidence string, last_verified_at string"
    ).withColumn("last_verified_at", F.col("last_verified_at").cast("timestamp"))
    sources = spark.createDataFrame([], "source_id string, method string, source_status string")
    table, events = freshness.decay(entities, sources, F.lit("2026-02-01").cast("timestamp"))
    assert sorted((r["entity_ref"], r["confidence"]) for r in table.collect()) == [("a", "high"), ("b", "low")]
    assert events.count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "events.parquet":
            shutil.copy(f"{SF}/{name}", tmp_path / name)
    spark.read.parquet(f"{SF}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_change_feed", "stream_sessions"):
        run = entry.queries()[name]
        whole = sorted(map(str, run(spark, SF).collect()))
        assert whole and sorted(map(str, run(spark, str(tmp_path)).collect())) == whole, name


def test_normal_forms_are_full_decompositions(spark):
    """Every character that decomposes, between letters, against Python's NFKD."""
    def normal(name):
        bare = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", name.lower()))
        return re.sub("[^a-z0-9]+", " ", bare).strip()

    def slug(name):
        flat = unicodedata.normalize("NFKD", name.lower())
        return re.sub("[^a-z0-9]+", "-", flat).strip("-")

    assert normal("\ufb01ne \u00bd \uff21 \U0001d41a") == "fine 1 2 a a"
    names = [f"a{chr(p)}B" for p in range(0x80, 0x30000) if unicodedata.decomposition(chr(p))]
    names += ["\ufb01ne arts \u00bd", "\u00d1o\u0301 \ufb04", "plain", ""]
    sql.register(spark)
    df = spark.createDataFrame([(n,) for n in names], "x string").select(
        "x", X.normalize_name(F.col("x")).alias("n"), X.slugify(F.col("x")).alias("s"),
        F.expr("normalize_name(x)").alias("sql_n"), F.expr("slugify(x)").alias("sql_s"))
    for r in df.collect():
        assert (r.n, r.sql_n) == (normal(r.x),) * 2, ascii(r.x)
        if not re.search(r"\s", r.x[1:2]):  # slugs clean white space first
            assert (r.s, r.sql_s) == (slug(r.x),) * 2, ascii(r.x)


def test_character_references_are_decoded_once(spark):
    cases = ["Ni&ntilde;o&#8217;s", "a &amp;ntilde; b", "&lt;b&gt; &hellip;", "&#x1F600;!&#x41", "&#0; &#xD800; &#150;",
             "&unknownname; &", "tail &eacute", "&amp;", "", "x&#65;&#66;y", "&notin; &CounterClockwiseContourIntegral;"]
    df = spark.createDataFrame([(c,) for c in cases] + [(None,)], "x string")
    for r in df.select("x", X.unescape(F.col("x")).alias("got")).collect():
        assert r.got == (None if r.x is None else html.unescape(r.x)), r.x
    # In a link, a parameter that is named like a reference stays one.
    page = spark.createDataFrame(
        [(1, '<a href=/p?a=1&copy=2&amp;b=3 title="caf&eacute; href=no">T&uacute;</a>')], "page_id int, html string")
    row = E.extract_anchors(page).first()
    assert (row.href, row.title, row.text) == ("/p?a=1&copy=2&b=3", "caf\u00e9 href=no", "T\u00fa")


def test_accordion_headers_with_inner_elements(spark):
    page = """<div class="card-header" id='heading-1'><div><h5><a>Level <i>one</i></a> more</h5></div><p>x</p></div>
      <div id="heading-1-7"><h5>Arts</h5><small>new</small></div><div id="heading-2-8"><div>Law</div></div>
      <div id="heading-1-9"></div><div id="heading-"></div>"""
    rows = E.extract_nested(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).collect()
    assert [(r.group_id, r.item_id, r.name, r.group_name, r.warning) for r in sorted(rows, key=lambda r: r.pos)] == [
        ("1", "7", "Arts", "Level one", None), ("2", "8", "Law", None, "item has no group header"),
        ("1", "9", "", "Level one", "item has no name")]


def test_bodies_of_one_host_keep_their_groups_apart(spark):
    bodies = spark.createDataFrame([("h", "User-agent: *\nDisallow: /a"), ("h", "User-agent: bot\nDisallow: /b"),
                                    ("h", "User-agent: bot\nDisallow: /b")], "host string, body string")
    got = sorted((tuple(r.agents), r.path) for r in A.robots_rules(bodies).collect())
    assert got == [(("*",), "/a"), (("bot",), "/b")]


def test_gate_state_does_not_depend_on_the_order_of_batches(spark, tmp_path):
    schema = "source_id string, snapshot_id long, fetched_at long, content_hash string"
    rows = [("a", i, i, f"h{i // 2}") for i in range(8)] + [("b", 9, 1, "k")]
    states = []
    for name, order in (("by-time", rows), ("mixed", random.Random(3).sample(rows, len(rows)))):
        step = S.content_gate_step(f"{tmp_path}/{name}", f"{tmp_path}/{name}-out", F.col("fetched_at"))
        for batch in range(3):
            step(spark.createDataFrame(order[batch * 3:batch * 3 + 3], schema), batch)
        states.append(sorted(map(str, store.read_version(spark, f"{tmp_path}/{name}").collect())))
    assert states[0] == states[1] and "h3" in states[0][0]


def test_a_partial_batch_holds_nothing_back_and_ages_nothing(spark):
    schema = "owner string, site string, slug string, status string, source_id string, pos int"
    table = "owner string, site string, slug string, status string, source_id string, " \
            "first_seen_at timestamp, last_verified_at timestamp, confidence string, miss_count int"
    now = dt.datetime(2026, 1, 1)
    current = spark.createDataFrame([("a", "a", f"s{i}", "active", "s", now, now, "high", 0) for i in range(12)], table)
    batch = spark.createDataFrame([("a", "a", "s0", "closed", "s", 1)], schema)
    none = spark.createDataFrame([], "owner string, entity_type string, min_rows int, max_rows int")

    def run(partial):
        return ingest.plan(batch, current, batch.select("source_id").distinct(), none, entity_type="program", run_id="r",
                           now=F.lit(now), fields=["status"], partial=partial)

    assert run(False).quarantine.count() == 1
    made = run(True)
    assert made.quarantine.count() == 0 and made.events.count() == 1
    state = {r.slug: (r.status, r.miss_count) for r in made.next_state.collect()}
    assert state.pop("s0") == ("closed", 0) and set(state.values()) == {("active", 0)} and len(state) == 11


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("by_date", [True, False])
def test_upserts_do_not_depend_on_how_the_input_is_cut(spark, tmp_path, monkeypatch, by_date):
    for name in os.listdir(SF):
        if name != "orders.parquet":
            shutil.copy(f"{SF}/{name}", tmp_path / name)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    (orders.repartitionByRange(3, "o_orderdate") if by_date else orders.repartition(3)).write.parquet(
        f"{tmp_path}/orders.parquet")
    run = entry.queries()["stream_upsert"]
    whole = sorted(map(str, run(spark, SF).collect()))
    plain = S.read_stream
    monkeypatch.setattr(S, "read_stream", lambda *args: plain(*args, files_per_batch=1))
    assert whole and sorted(map(str, run(spark, str(tmp_path)).collect())) == whole
