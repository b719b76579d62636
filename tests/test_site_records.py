"""Page shapes to records, and a whole first run from pages to published rows."""

import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import hashing as H
from attesta.operators import gate as G
from attesta.operators import match as M
from attesta.operators import validate as V
from attesta.plans import ingest
from attesta.plans import site_records as P


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string")


ACCORDION = """<div class="card-header" id="heading-1"><h5><a>UNDERGRADUATE</a></h5></div>
<div class="card-header" id="heading-1-10"><h5><a>BS Civil Engineering</a></h5></div>
<div class="card-header" id="heading-1-11"><h5><a>BET major in Foundry</a></h5></div>
<div class="card-header" id="heading-1-12"><h5><a>bs  civil engineering</a></h5></div>
<div class="card-header" id="heading-1-13"><h5><a></a></h5></div>
<div class="card-header" id="heading-2-14"><h5><a>MS Physics</a></h5></div>"""


def test_accordion(spark, rows):
    records, warnings = P.offerings_from_accordion(pages(spark, ("https://h/courses/coe", ACCORDION)))
    assert rows(records, "source_name", "slug", "unit_slug", "majors", "years") == [
        ("BET major in Foundry", "bet-major-in-foundry", "coe", ["Foundry"], None),
        ("BS Civil Engineering", "bs-civil-engineering", "coe", [], None),
        ("MS Physics", "ms-physics", "coe", [], None)]
    assert rows(warnings, "warning") == [
        ("card with no title",), ("duplicate on this page: bs-civil-engineering",),
        ("item has no group header",)]
    valid, rejects = V.validate(records, {"program_offering": V.OFFERING_RULES})
    assert (valid.count(), rejects.count()) == (3, 0)


def test_linked_cards(spark, rows):
    def card(title, href, years):
        return (f'<article class="ug-card"><h3 class="ug-card__title">{title}</h3>'
                f'<span class="ug-card__years">{years}</span>'
                f'<a class="ug-card__link" href="{href}">Details</a></article>')
    html = (card("BS Mechanical", "/academics/coe/programs/bsme", "4.5 years")
            + card("BS Again", "/academics/coe/programs/bsme", "4 years")
            + card("BS Lost", "/elsewhere", "4 years") + card("", "/academics/x/programs/y", ""))
    records, warnings = P.offerings_from_linked_cards(pages(spark, ("https://h/a", html)))
    got = [(r.source_name, r.slug, r.unit_slug, float(r.years)) for r in records.collect()]
    assert got == [("BS Mechanical", "bsme", "coe", 4.5)]
    assert rows(warnings, "warning") == [
        ('"BS Lost" has no program link',), ("card with no title",), ("duplicate on this page: bsme",)]


def test_columns(spark, rows):
    def column(cls, title):
        return f'<div class="courses-col {cls}"><h4 class="courses-title"><a href="#">{title}</a></h4></div>'
    html = column("eaad wide", "BS Electrical") + column("", "BS Free") + column("basd", "")
    records, warnings = P.offerings_from_columns(pages(spark, ("https://h/p", html)), ["basd", "eaad"])
    assert rows(records, "slug", "unit_slug") == [("bs-electrical", "eaad"), ("bs-free", None)]
    assert rows(warnings, "warning") == [('"BS Free" names no unit',), ("card with no title",)]


def test_units_from_anchors_and_cards(spark, rows):
    html = """<a href="pagecollege/academics/coe">Home</a><a href="pagecollege/academics/cos">x</a>
      <a href="pagecollege/academics/coe" title="College of Engineering">more</a><a href="/no">n</a>"""
    records, warnings = P.units_from_anchors(pages(spark, ("https://h/a", html)))
    assert rows(records, "slug", "name", "unit_type") == [("coe", "College of Engineering", "college")]
    assert rows(warnings, "warning") == [("unit without a name: cos",)]
    card = ('<article class="acad-college-card"><h3 class="acad-college-card__title"><a href="{}">{}</a>'
            '</h3><p class="acad-college-card__text">Prose.</p></article>')
    html = card.format("/academics/cas/", "Arts") + card.format("/academics/cas", "Twice") + card.format("", "No")
    records, warnings = P.units_from_cards(pages(spark, ("https://h/a", html)))
    assert rows(records, "slug", "name", "description") == [("cas", "Arts", "Prose.")]
    assert rows(warnings, "warning") == [("card with no slug or name",)]
    assert V.validate(records, {"academic_unit": V.UNIT_RULES})[1].count() == 0


def test_unit_pages_prefer_the_navigation_and_gate_the_person(spark, rows):
    def page(slug, nav, heading, person, caption):
        return (f"https://h/academics/department/{slug}",
                f'<nav><a href="/academics/department/{slug}">{nav}</a></nav>'
                f'<h2 class="about-title">{heading}</h2><div class="testimonials-area">'
                f'<div class="testimonials-title"><h2 class="title">{person}</h2><p>{caption}</p></div></div>')
    records, warnings = P.units_from_pages(pages(
        spark, page("eaad", "Electrical and Allied Department", "Electrical and AlliedDepartment",
                    "Ann Cruz", "Department Head"),
        page("basd", "", "Basic Arts", "Bob Reyes", "Secretary"), page("none", "", "", "", "")))
    assert rows(records, "slug", "name", "abbreviation", "head_name", "head_title") == [
        ("basd", "Basic Arts", "BASD", None, None),
        ("eaad", "Electrical and Allied Department", "EAAD", "Ann Cruz", "Department Head")]
    assert rows(warnings, "warning") == [
        ("caption does not state the role; not published",),
        ("nav and heading differ; using nav",), ("page names no unit: none",)]


def test_from_pages_to_published_rows(spark, rows):
    """Gate, extract, validate, resolve, merge, publish; then again with nothing changed."""
    now = F.lit(dt.datetime(2026, 8, 29))
    raw = pages(spark, ("https://h/courses/coe", ACCORDION)).withColumn(
        "source_id", F.col("url")).withColumn("content_hash", H.content_hash(F.col("html")))
    none = spark.createDataFrame([], "source_id string, previous_hash string")
    fetched = G.gate(raw, none).filter("gate = 'fetched'")
    registry = spark.createDataFrame(
        [("bsce", "Bachelor of Science in Civil Engineering", ["BS Civil Engineering"], 1)],
        "slug string, name string, aliases array<string>, ord int")
    records, _ = P.offerings_from_accordion(fetched.select("page_id", "url", "html"))
    valid, _ = V.validate(records, {"program_offering": V.OFFERING_RULES})
    named = M.resolve_names(valid, registry, "source_name")
    incoming = named.join(raw.select("page_id", "source_id"), "page_id").select(
        F.lit("h").alias("owner"), F.lit("h").alias("site"),
        F.coalesce("match_slug", "slug").alias("slug"), "source_name", "majors", "status",
        "source_id", "pos")
    table = spark.createDataFrame([], "owner string, site string, slug string, source_name string, "
                                      "majors array<string>, status string, source_id string, "
                                      "first_seen_at timestamp, last_verified_at timestamp, "
                                      "confidence string, miss_count int")
    expect = spark.createDataFrame([("h", "program_offering", 1, 9)],
                                   "owner string, entity_type string, min_rows int, max_rows int")

    def run(current, mode):
        return ingest.plan(incoming, current, fetched.select("source_id"), expect, run_id="r",
                           entity_type="program_offering", now=now, mode=mode, arrays=["majors"],
                           fields=["source_name", "majors", "status"], settle=True)

    first = run(table, "full")
    assert rows(first.next_state, "slug") == [("bet-major-in-foundry",), ("bsce",), ("ms-physics",)]
    assert first.events.count() == 3
    assert run(first.next_state, "full").events.count() == 0
    seen = G.gate(raw, G.latest_hash(raw.select("source_id", "content_hash", F.lit(1).alias(
        "fetched_at"), F.lit(1).alias("snapshot_id"))))
    assert rows(seen, "gate") == [("unchanged",)]


def test_emptied_pages_are_reported_by_every_shape(spark, rows):
    empty = pages(spark, ("https://h/a/x", "<p>Nothing here</p>"), ("https://h/a/y", ""))
    for shape, what in ((P.offerings_from_accordion, "programs"),
                        (P.offerings_from_linked_cards, "program cards"),
                        (lambda p: P.offerings_from_columns(p, []), "course cards"),
                        (P.units_from_anchors, "units"), (P.units_from_cards, "unit cards")):
        records, warnings = shape(empty)
        assert records.count() == 0
        assert rows(warnings, "page_id", "warning") == [
            (i, f"no {what} found on this page") for i in (0, 1)]


def test_old_tables_describe_and_abbreviate_units(spark, rows):
    cell = '<td><p><a href="pages/academics/{0}">{0}</a></p><p>{1}</p><p>{2}</p></td>'
    html = ("".join(f'<a href="pagecollege/academics/{s}" title="College {s}"></a>' for s in ("a", "b", "c", "d"))
            + "<table><tr>" + cell.format("a", "The College (CAB) of", "arts &amp; (XY) more") + cell.format("b", "", "")
            + cell.format("z", "of no unit", "") + cell.format("c", "old", "prose")
            + cell.format("c", "new (toolongabbr)", "") + "</tr></table>"
            + '<a href="pages/academics/d">outside of cells</a>')
    records, _ = P.units_from_anchors(pages(spark, ("https://h/a", html)))
    assert rows(records, "slug", "description", "abbreviation") == [
        ("a", "The College (CAB) of arts & (XY) more", "CAB"), ("b", None, None),
        ("c", "new (toolongabbr)", None), ("d", None, None)]


def test_departments_are_described_by_the_block_of_their_heading(spark, rows):
    block = '<div class="about-content wide"><div><h2 class="about-title">{}</h2></div>{}</div>'
    records, _ = P.units_from_pages(pages(
        spark, ("https://h/d/one", "<p>before</p>" + block.format("One", "<p>First <b>text</b>.</p><p>more</p>")),
        ("https://h/d/two", '<h2 class="about-title">Two</h2>' + block.format("Later", "<p>not its own</p>")),
        ("https://h/d/three", block.format("Three", "")), ("https://h/d/four", block.format("Four", "<p> </p>"))))
    assert rows(records, "slug", "name", "description") == [
        ("four", "Four", None), ("one", "One", "First text."), ("three", "Three", None), ("two", "Two", None)]
