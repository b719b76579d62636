"""From page shapes to catalogue records, set by set.

Each function takes pages (page_id, url, html) of one shape, from any number of sites, and
returns (records, warnings); where several outputs share parsed pages, these are parsed and
written once while the frames are built. Records have the shape the validators expect; warnings are
(page_id, warning) rows. Nothing is guessed: what a page does not state stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import extract as E
from attesta.session import materialize

# Where the known page shapes keep their records.
COLLEGE_CARDS = E.CardSpec(card=("article", "acad-college-card"),
                           title=("h3", "acad-college-card__title"),
                           text=("p", "acad-college-card__text"))
DEGREE_CARDS = E.CardSpec(card=("article", "ug-card"), title=("h3", "ug-card__title"),
                          link=("a", "ug-card__link"), badge=("span", "ug-card__years"))
DEGREE_COLUMNS = E.CardSpec(card=("div", "courses-col"), title=("h4", "courses-title"))
DEPARTMENT_HEADING = E.CardSpec(card=("h2", "about-title"))
PROFILE = E.CardSpec(card=("div", "testimonials-title"), title=("h2", "title"), text=("p", None))
DEGREE_LINK = r"(?i)/academics/([a-z0-9-]+)/programs/([a-z0-9-]+)"
UNIT_LINK = "pagecollege/academics/"
OLD_UNIT_LINK = "pages/academics/"
DEPARTMENT_TEXT = (None, "about-content")

OFFERING = ["page_id", "pos", "entity_type", "source_name", "slug", "local_name", "unit_slug",
            "majors", "years", "status", "accreditation", "curriculum_url"]
UNIT = ["page_id", "pos", "entity_type", "slug", "name", "abbreviation", "unit_type",
        "description", "head_name", "head_title", "emails", "website", "status"]


def _warn(df: DataFrame, message: Column) -> DataFrame:
    return df.select("page_id", message.alias("warning")).filter(F.col("warning").isNotNull())


def _nothing(pages: DataFrame, records: DataFrame, what: str) -> DataFrame:
    """A warning for every page of the shape that gave no record: an emptied page must not pass
    for one whose records were all withdrawn."""
    empty = pages.select("page_id").distinct().join(
        records.select("page_id").distinct(), "page_id", "left_anti")
    return empty.select("page_id", F.lit(f"no {what} found on this page").alias("warning"))


def _text_or_null(column: str) -> Column:
    return F.nullif(F.coalesce(F.col(column), F.lit("")), F.lit(""))


def _offerings(pages: DataFrame, items: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """`items`: page_id, pos, name, slug, unit_slug, years, each of them already looked up."""
    nameless = F.col("name") == ""
    problem = (F.when(nameless, "card with no title")
               .when(F.coalesce("slug", F.lit("")) == "", F.concat(
                   F.lit('"'), "name", F.lit('" gives no slug'))))
    usable = items.filter(~nameless & (F.coalesce("slug", F.lit("")) != ""))
    kept, extra = E.dedupe_in_page(usable)
    nothing = F.lit(None).cast("string")
    records = kept.withColumns({
        "entity_type": F.lit("program_offering"), "source_name": F.col("name"),
        "local_name": nothing, "majors": X.majors_of(F.col("name")), "status": F.lit("active"),
        "accreditation": nothing, "curriculum_url": nothing}).select(*OFFERING)
    return records, _warn(items, problem).unionByName(extra.select("page_id", "warning")).unionByName(
        _nothing(pages, usable, what))


def offerings_from_accordion(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two-level accordions; the page's last path segment is the owning unit."""
    items = materialize(E.extract_nested(pages).withColumn("slug", X.slugify(F.col("name"))),
                        "accordion")
    owners = pages.select("page_id", X.last_segment(F.col("url")).alias("unit_slug"))
    placed = items.join(owners, "page_id").withColumn("years", F.lit(None).cast("decimal(3,1)"))
    records, warnings = _offerings(pages, placed.select(
        "page_id", "pos", "name", "slug", "unit_slug", "years"), "programs")
    return records, warnings.unionByName(_warn(items.filter(F.col("name") != ""),
                                               F.col("warning")))


def offerings_from_linked_cards(pages: DataFrame, spec: E.CardSpec = DEGREE_CARDS
                                ) -> tuple[DataFrame, DataFrame]:
    """Cards whose own link names unit and slug; years come from the badge."""
    cards = materialize(E.extract_cards(pages, spec), "cards")
    unlinked = ~F.regexp(F.coalesce("link", F.lit("")), F.lit(DEGREE_LINK))
    named = F.col("title") != ""
    items = cards.filter(~unlinked | ~named).select(
        "page_id", "pos", F.col("title").alias("name"),
        F.regexp_extract("link", DEGREE_LINK, 2).alias("slug"),
        F.regexp_extract("link", DEGREE_LINK, 1).alias("unit_slug"),
        X.years_of(F.coalesce("badge", F.lit(""))).alias("years"))
    records, warnings = _offerings(pages, items, "program cards")
    lost = F.when(named & unlinked, F.concat(F.lit('"'), "title", F.lit('" has no program link')))
    return records, warnings.unionByName(_warn(cards, lost))


def offerings_from_columns(pages: DataFrame, known_units: Sequence[str],
                           spec: E.CardSpec = DEGREE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Cards whose class list names the owning unit; a card without one keeps a null unit."""
    cards = E.owner_from_tokens(E.extract_cards(pages, spec), known_units,
                                F.split("classes", r"\s+"))
    items = materialize(cards.select(
        "page_id", "pos", F.col("title").alias("name"), X.slugify(F.col("title")).alias("slug"),
        "unit_slug", F.lit(None).cast("decimal(3,1)").alias("years")), "cards")
    records, warnings = _offerings(pages, items, "course cards")
    ownerless = F.when((F.col("name") != "") & F.col("unit_slug").isNull(), F.concat(
        F.lit('"'), "name", F.lit('" names no unit')))
    return records, warnings.unionByName(_warn(items, ownerless))


def _units(rows: DataFrame, unit_type: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    blank = {c: nothing for c in ("abbreviation", "description", "head_name", "head_title",
                                  "website") if c not in rows.columns}
    return rows.withColumns({
        **blank, "entity_type": F.lit("academic_unit"), "unit_type": F.lit(unit_type),
        "emails": F.array().cast("array<string>"), "status": F.lit("active")}).select(*UNIT)


def units_from_anchors(pages: DataFrame, prefix: str = UNIT_LINK, unit_type: str = "college",
                       old_prefix: str = OLD_UNIT_LINK) -> tuple[DataFrame, DataFrame]:
    """Anchors under a path prefix, one unit per slug, named by the first title given.

    Pages may still carry the older table of units beside it, where each cell links to one and
    holds its prose: the last such cell with any describes the unit, and capitals in brackets there
    are its abbreviation.
    """
    anchors = E.extract_anchors(pages).filter(F.startswith("href", F.lit(prefix)))
    found = materialize(E.first_title(anchors), "anchors")
    cells = E.text_beside_anchors(pages, old_prefix).filter(F.col("text") != "")
    prose = cells.groupBy("page_id", X.last_segment(F.col("href")).alias("slug")).agg(
        F.max_by("text", "pos").alias("description"))
    short = F.regexp_extract("description", r"\(([A-Z]{2,6})\)", 1)
    units = found.filter(F.col("name").isNotNull()).join(prose, ["page_id", "slug"], "left")
    unnamed = F.when(F.col("name").isNull(), F.concat(F.lit("unit without a name: "), "slug"))
    return (_units(units.withColumn("abbreviation", F.nullif(short, F.lit(""))), unit_type),
            _warn(found, unnamed).unionByName(_nothing(pages, units, "units")))


def units_from_cards(pages: DataFrame, spec: E.CardSpec = COLLEGE_CARDS,
                     unit_type: str = "college") -> tuple[DataFrame, DataFrame]:
    cards = materialize(E.extract_cards(pages, spec), "cards").withColumn(
        "slug", X.last_segment(F.coalesce("link", F.lit(""))))
    good = (F.col("title") != "") & (F.col("slug") != "")
    kept, _ = E.dedupe_in_page(cards.filter(good))
    rows = kept.select("page_id", "pos", "slug", F.col("title").alias("name"),
                       _text_or_null("text").alias("description"))
    return _units(rows, unit_type), _warn(cards, F.when(
        ~good, "card with no slug or name")).unionByName(_nothing(pages, rows, "unit cards"))


def units_from_pages(pages: DataFrame, unit_type: str = "department", role: str = "head"
                     ) -> tuple[DataFrame, DataFrame]:
    """One unit per page: named by the navigation, else by the page's heading, described by the
    first paragraph of the heading's block; a head only where the caption says so. The slug is the
    page's last path segment."""
    slugs = pages.select("page_id", X.last_segment(F.col("url")).alias("slug"))
    own = E.extract_anchors(pages.select("page_id", "html")).withColumnRenamed(
        "slug", "target").join(slugs, "page_id").filter(
        (F.col("target") == F.col("slug")) & (F.col("text") != ""))
    nav = own.groupBy("page_id").agg(F.min_by("text", "pos").alias("nav"))

    def first(spec: E.CardSpec, *columns: Column) -> DataFrame:
        cards = E.extract_cards(pages, spec)
        return cards.filter(F.col("pos") == 0).select("page_id", *columns)

    heading = first(DEPARTMENT_HEADING, F.col("title").alias("heading"))
    profile = first(PROFILE, F.col("title").alias("person"), F.col("text").alias("caption"))
    prose = E.text_around(pages, DEPARTMENT_HEADING.card, DEPARTMENT_TEXT).select(
        "page_id", F.nullif("text", F.lit("")).alias("description"))
    joined = slugs.join(nav, "page_id", "left").join(heading, "page_id", "left").join(
        profile, "page_id", "left").join(prose, "page_id", "left")
    named = E.prefer(joined, "nav", "heading", "name").withColumnRenamed("warning", "_name")
    gated = E.gate_by_caption(named, "person", "caption", role)
    rows = gated.filter(F.col("name").isNotNull()).select(
        "page_id", F.lit(0).alias("pos"), "slug", "name",
        F.upper("slug").alias("abbreviation"), "description", F.col("published_name").alias("head_name"),
        F.when(F.col("published_name").isNotNull(), F.col("caption")).alias("head_title"))
    missing = F.when(F.col("name").isNull(), F.concat(F.lit("page names no unit: "), "slug"))
    warnings = _warn(gated, missing).unionByName(_warn(gated, F.col("_name"))).unionByName(
        _warn(gated, F.col("warning")))
    return _units(rows, unit_type), warnings
