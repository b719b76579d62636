"""Queries over extraction, text functions, validation, matching and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import sql as sql_functions
from attesta.functions import text as X
from attesta.operators import extract as E
from attesta.operators import match as M
from attesta.operators import validate as V
from attesta.operators.extract import parse_html
from attesta.plans import bindings as B
from attesta.plans import site_records as P
from attesta.plans.registry import query
from attesta.sources.scans import load_table

CLEAN_SQL = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def normal_sql(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


def slug_sql(x: str) -> str:
    marked = rf"regexp_replace(lower({x}), '([à-öù-ÿ])', '\1-', 'g')"
    return rf"trim(regexp_replace(strip_accents({marked}), '[^a-z0-9]+', '-', 'g'), '-')"


def grams_sql(x: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return (f"list_distinct(flatten(list_transform({words}, lambda w: list_transform("
            "range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def similarity_sql(a: str, b: str) -> str:
    """Of two gram lists."""
    return (f"len(list_intersect({a}, {b})) / "
            f"nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0)")


# --- text --------------------------------------------------------------------------------

@query("clean_text", f"SELECT doc_id, {CLEAN_SQL.format(x='text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return load_table(spark, sf, "documents").select(
        "doc_id", X.clean(F.col("text")).alias("cleaned"))


@query("slugify", f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents")
def slugify(spark, sf):
    return load_table(spark, sf, "documents").select(
        "doc_id", X.slugify(F.col("text")).alias("slug"))


_NORMAL = f"SELECT conv_id, turn, {normal_sql('text')} AS normal_name, " \
          f"replace({normal_sql('text')}, ' ', '-') AS name_slug FROM conversations"


@query("normalize_name", _NORMAL)
def normalize_name(spark, sf):
    return load_table(spark, sf, "conversations").select(
        "conv_id", "turn", X.normalize_name(F.col("text")).alias("normal_name"),
        X.name_slug(F.col("text")).alias("name_slug"))


@query("normalize_name_exact", _NORMAL)
def normalize_name_exact(spark, sf):
    normal = X.normalize_name_exact(F.col("text"))
    return load_table(spark, sf, "conversations").select(
        "conv_id", "turn", normal.alias("normal_name")).withColumn(
        "name_slug", F.replace("normal_name", F.lit(" "), F.lit("-")))


@query("last_segment", r"""SELECT page_id, coalesce(list_filter(string_split(regexp_replace(url,
  '[?#].*$', ''), '/'), lambda p: p <> '')[-1], '') AS segment FROM pages""")
def last_segment(spark, sf):
    return B.pages(spark, sf).select("page_id", X.last_segment(F.col("url")).alias("segment"))


@query("majors_and_years", r"""SELECT p_partkey, CASE WHEN p_size < 40
  THEN p_type || ' ' || p_name END AS majors,
  CASE WHEN p_size BETWEEN 1 AND 12 THEN CAST(p_size AS DOUBLE) END AS years FROM part""")
def majors_and_years(spark, sf):
    p = load_table(spark, sf, "part")
    tail = F.concat_ws(" ", "p_type", "p_name")
    name = F.when(F.col("p_size") < 20, F.concat(F.lit("BS in Parts: Major  in "), tail)).when(
        F.col("p_size") < 40, F.concat(F.lit("BS with specializations in "), tail)).otherwise(tail)
    text = F.concat(F.lit("takes "), F.col("p_size").cast("string"), F.lit(" Years"))
    return p.select("p_partkey", F.get(X.majors_of(name), F.lit(0)).alias("majors"),
                    X.years_of(text).cast("double").alias("years"))


# --- extraction --------------------------------------------------------------------------

_BARE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')"
ANCHORS_SQL = rf"""anchors AS (SELECT page_id, url, unnest(list) AS a,
  CAST(generate_subscripts(list, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, url, regexp_extract_all({_BARE}, '(?is)<a\s[^>]*>.*?</a\s*>') AS list
    FROM pages))"""


@query("extract_anchors", rf"""WITH {ANCHORS_SQL}
SELECT page_id, pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {B.text_sql("a")} AS text
FROM anchors""")
def extract_anchors(spark, sf):
    return E.extract_anchors(B.pages(spark, sf)).select("page_id", "pos", "href", "text")


@query("first_title", rf"""WITH {ANCHORS_SQL}, s AS (SELECT page_id, pos,
  regexp_extract(regexp_replace(regexp_extract(a, 'href="([^"]*)"', 1), '/+$', ''), '([^/]*)$', 1) AS slug,
  {B.text_sql("a")} AS text FROM anchors)
SELECT page_id, slug, min(pos) AS pos, arg_min(text, pos) FILTER (text <> '') AS name
FROM s WHERE slug <> '' GROUP BY 1, 2""")
def first_title(spark, sf):
    return E.first_title(E.extract_anchors(B.pages(spark, sf)), "text")


def article_parser(url, html):
    """Example user parser: an article's heading, and its lead as description."""
    page = parse_html(html)
    article = page.first("article")
    heading = article.first("h1").text() if article and article.first("h1") else ""
    if not heading:
        return {}, ["article without a heading"]
    footer = page.first("footer")
    return ({"announcement": [{"title": heading, "url": url}]},
            [] if footer else ["page has no footer"])


def links_parser(url, html):
    """Example user parser: the navigation of a page."""
    nav = parse_html(html).first("nav")
    items = [a for a in nav.all("a")] if nav else []
    return {"academic_unit": [{"slug": a.attrs.get("href", "").strip("/"), "name": a.text()}
                              for a in items]}, []


def parsers():
    return E.ParserRegistry(
        E.SiteParser("article", "example", article_parser, {"announcement": (1, 10)}),
        E.SiteParser("links", "example", links_parser, {"academic_unit": (1, 100)}))


ROUTES = [(r"^/en/", "article"), (r"^/(fr|de)/", "links")]

_RECORDS_SQL = rf"""SELECT page_id, CASE WHEN lang = 'en' THEN 'article'
    WHEN lang IN ('fr', 'de') THEN 'links' END AS parser,
  CASE WHEN lang = 'en' THEN 'announcement' WHEN lang IN ('fr', 'de') THEN 'academic_unit' END
    AS entity_type, CAST(CASE WHEN lang = 'en' THEN 1 WHEN lang IN ('fr', 'de') THEN
    len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<a ')) ELSE 0 END AS BIGINT)
    AS records, CAST(CASE WHEN lang = 'en' AND html NOT LIKE '%<footer>%' THEN 1
    WHEN lang IN ('en', 'fr', 'de') THEN 0 ELSE 1 END AS BIGINT) AS warnings
FROM (SELECT page_id, html, {B.LANG_SQL} AS lang FROM pages)"""


@query("extract_records", _RECORDS_SQL)
def extract_records(spark, sf):
    rows = E.extract_records(B.pages(spark, sf), ROUTES, parsers())
    return rows.groupBy("page_id", "parser").agg(
        F.max("entity_type").alias("entity_type"), F.count("record").alias("records"),
        F.count("warning").alias("warnings"))


@query("extracted_titles", rf"""WITH {B.PAGE_TEXTS_SQL}
SELECT page_id, url, heading AS title FROM page_texts
WHERE regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1) = 'en'""")
def extracted_titles(spark, sf):
    rows = E.extract_records(B.pages(spark, sf), ROUTES, parsers())
    return rows.filter("entity_type = 'announcement'").select("page_id", F.from_json(
        "record", "title string, url string").alias("r")).select("page_id", "r.url", "r.title")


_LI = rf"""cards AS (SELECT page_id, unnest(list) AS card,
  CAST(generate_subscripts(list, 1) - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') AS list FROM pages))"""


@query("extract_cards", rf"""WITH {_LI} SELECT page_id, pos, {B.text_sql("card")} AS title,
  regexp_extract(card, 'href="([^"]*)"', 1) AS link FROM cards""")
def extract_cards(spark, sf):
    spec = E.CardSpec(card=("li", None), title=("a", None))
    return E.extract_cards(B.pages(spark, sf), spec).select("page_id", "pos", "title", "link")


def _accordions(spark, sf):
    """A document as an accordion page: its lines under its language; German has no header."""
    def div(ident, text):
        safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"),
                                   F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit('<div class="card-header" id="heading-'), ident, F.lit('"><h5><a>'),
                        safe, F.lit("</a></h5></div>"))

    lines = F.transform(F.split("text", "\n"), lambda line, i: div(
        F.concat("lang", F.lit("-"), i.cast("string")), line))
    header = F.when(F.col("lang") != "de", div(F.col("lang"), F.concat(F.lit("Group "), "lang")))
    return load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.array_join(F.concat(F.array(header), lines), "\n").alias("html"))


@query("extract_nested", f"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id AS page_id, lang AS group_id, CAST(i AS VARCHAR) AS item_id,
  {CLEAN_SQL.format(x="line")} AS name, CASE WHEN lang <> 'de' THEN 'Group ' || lang END AS group_name,
  CASE WHEN {CLEAN_SQL.format(x="line")} = '' THEN 'item has no name'
    WHEN lang = 'de' THEN 'item has no group header' END AS warning FROM l""")
def extract_nested(spark, sf):
    return E.extract_nested(_accordions(spark, sf)).drop("pos")


@query("dedupe_in_page", rf"""WITH {ANCHORS_SQL}, s AS (SELECT page_id, pos,
  regexp_extract(regexp_replace(regexp_extract(a, 'href="([^"]*)"', 1), '/+$', ''), '([^/]*)$', 1) AS slug
  FROM anchors)
SELECT page_id, slug, pos, CASE WHEN row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) > 1
  THEN 'duplicate on this page: ' || slug END AS warning FROM s""")
def dedupe_in_page(spark, sf):
    kept, extra = E.dedupe_in_page(E.extract_anchors(B.pages(spark, sf)))
    wanted = ["page_id", "slug", "pos", "warning"]
    return kept.withColumn("warning", F.lit(None).cast("string")).select(*wanted).unionByName(
        extra.select(*wanted))


@query("prefer_heading", f"""WITH {B.PAGE_TEXTS_SQL}
SELECT page_id, coalesce(nullif(heading, ''), nullif(lead, '')) AS name,
  CASE WHEN nullif(heading, '') <> nullif(lead, '') THEN 'heading and lead differ; using heading'
  END AS warning FROM page_texts""")
def prefer_heading(spark, sf):
    return E.prefer(B.page_texts(spark, sf), "heading", "lead", "name").select(
        "page_id", "name", "warning")


@query("gate_by_caption", f"""WITH {B.PAGE_TEXTS_SQL}
SELECT page_id, CASE WHEN heading <> '' AND regexp_matches(caption, '(?i)head|tion') THEN heading END
  AS published_name, CASE WHEN heading <> '' AND NOT regexp_matches(caption, '(?i)head|tion')
  THEN 'caption does not state the role; not published' END AS warning FROM page_texts""")
def gate_by_caption(spark, sf):
    return E.gate_by_caption(B.page_texts(spark, sf), "heading", "caption", "head|tion").select(
        "page_id", "published_name", "warning")


@query("flag_embeds", r"""SELECT page_id, CAST(len(list_filter(regexp_extract_all(html,
  '<a\s[^>]*>'), lambda t: regexp_matches(t, 'href="[^"]*th'))) AS INTEGER) AS embeds FROM pages""")
def flag_embeds(spark, sf):
    return E.flag_embeds(B.pages(spark, sf), "a", "href", "th").select("page_id", "embeds")


@query("owner_from_tokens", r"""SELECT page_id, list_filter(string_split(regexp_extract(url,
  '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda t: t IN ('en', 'de', 'es'))[1] AS unit_slug
FROM pages""")
def owner_from_tokens(spark, sf):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return E.owner_from_tokens(B.pages(spark, sf), ["en", "de", "es"], F.split(path, "/")).select(
        "page_id", "unit_slug")


_TEXT_SQL = B.text_sql(_BARE)


@query("verbatim_check", rf"""WITH {_LI}, t AS (SELECT page_id, {_TEXT_SQL} AS body FROM pages)
SELECT c.page_id, pos, {B.text_sql("card")} AS name, contains(body, {B.text_sql("card")}) AS verbatim
FROM cards c JOIN t ON t.page_id = c.page_id""")
def verbatim_check(spark, sf):
    pages = B.pages(spark, sf)
    cards = E.extract_cards(pages, E.CardSpec(card=("li", None), title=("a", None)))
    return E.verbatim_check(cards.withColumnRenamed("title", "name"), pages).select(
        "page_id", "pos", "name", "verbatim")


@query("discover_items", rf"""WITH {ANCHORS_SQL}
SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)
  || regexp_replace(regexp_extract(a, 'href="([^"?#]*)', 1), '/+$', '') AS item_url FROM anchors
WHERE regexp_extract(a, 'href="([^"]*)"', 1) LIKE '/%'""")
def discover_items(spark, sf):
    pages = B.pages(spark, sf)
    return E.discover_items(pages, pages)


@query("discover_sources", f"""WITH {B.SITES_SQL}
SELECT site, 'https://' || site || '.example.org/units/' || lower(replace(s_name, '#', '-')) AS url
FROM supplier JOIN sites ON s_nationkey = site_key""")
def discover_sources(spark, sf):
    sites = B.sites(spark, sf)
    slugs = load_table(spark, sf, "supplier").join(
        sites, F.col("s_nationkey") == F.col("site_key")).select(
        "site", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("slug"))
    origins = sites.select("site", F.concat(F.lit("https://"), "site", F.lit(".example.org"))
                           .alias("origin"))
    return E.discover(origins, slugs, "{origin}/units/{slug}").select("site", "url")


# --- validation --------------------------------------------------------------------------

def _records(spark, sf):
    """Conversation turns as records: role as type, text as name."""
    c = load_table(spark, sf, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("record_id"),
        F.col("conv_id").cast("string").alias("source_id"), F.col("turn").alias("pos"),
        B.pick({"user": "academic_unit", "assistant": "program_offering", "system": "procedure"},
               F.col("role")).alias("entity_type"),
        F.element_at(F.split(F.split("text", "\n", 2)[0], " "), 1).alias("slug"),
        F.col("text").alias("name"), F.col("turn").cast("double").alias("years"))


_RULES = {
    "academic_unit": [V.slug("slug"), V.non_empty("name")],
    "program_offering": [V.in_range("years", 0, 3, True), V.slug("slug", True)],
}
_RECORDS_CTE = """r AS (SELECT conv_id || '-' || turn AS record_id,
  CAST(conv_id AS VARCHAR) AS source_id, turn, CASE role WHEN 'user' THEN 'academic_unit'
  WHEN 'assistant' THEN 'program_offering' ELSE 'procedure' END AS entity_type,
  string_split(string_split(text, chr(10))[1], ' ')[1] AS slug, text AS name FROM conversations),
v AS (SELECT *, regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') AS good FROM r),
w AS (SELECT *, CASE WHEN entity_type = 'academic_unit' THEN
    CASE WHEN NOT good THEN 'slug' WHEN trim(name) = '' THEN 'name' END
  WHEN entity_type = 'program_offering' THEN
    CASE WHEN NOT (turn > 0 AND turn <= 3) THEN 'years' WHEN NOT good THEN 'slug' END END AS field
  FROM v)"""


@query("validate_records", f"""WITH {_RECORDS_CTE} SELECT record_id, entity_type, field
FROM w WHERE entity_type <> 'procedure'""")
def validate_records(spark, sf):
    valid, rejects = V.validate(_records(spark, sf), _RULES)
    wanted = ["record_id", "entity_type", "field"]
    return rejects.select(*wanted).unionByName(
        valid.withColumn("field", F.lit(None).cast("string")).select(*wanted))


@query("reject_messages", f"""WITH {_RECORDS_CTE}
SELECT entity_type, field, CASE field WHEN 'slug' THEN
  'must be lowercase alphanumeric with single hyphens' WHEN 'years' THEN 'outside (0, 3]'
  ELSE 'must not be empty' END AS message, count(*) AS records
FROM w WHERE field IS NOT NULL GROUP BY ALL""")
def reject_messages(spark, sf):
    return V.validate(_records(spark, sf), _RULES)[1].groupBy(
        "entity_type", "field", "message").agg(F.count(F.lit(1)).alias("records"))


@query("unknown_fields", """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error,k'
  ELSE 'k' END AS unknown_fields FROM events""")
def unknown_fields(spark, sf):
    e = load_table(spark, sf, "events")
    record = F.to_json(F.struct(
        F.col("event_type").alias("kind"), F.when(
            F.col("event_type") == "error", F.col("value")).alias("error"),
        F.get_json_object("props", "$.k").alias("k")))
    return V.reject_unknown_fields(e.withColumn("record", record), "record", ["kind"]).select(
        "event_id", F.array_join(F.sort_array("unknown_fields"), ",").alias("unknown_fields"))


@query("fill_defaults", """SELECT d.doc_id, coalesce(l.quality, -1) AS quality,
  coalesce(l.toxic, 0) AS toxic, 'active' AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_defaults(spark, sf):
    joined = load_table(spark, sf, "documents").select("doc_id").join(
        load_table(spark, sf, "labels"), "doc_id", "left")
    return V.fill_defaults(joined, {"quality": F.lit(-1), "toxic": F.lit(0),
                                    "status": F.lit("active")})


@query("unmodelled_types", f"""WITH {_RECORDS_CTE} SELECT source_id, entity_type,
  count(*) AS records, 'no record rules for entity type procedure' AS warning
FROM w WHERE entity_type = 'procedure' GROUP BY 1, 2""")
def unmodelled_types(spark, sf):
    return V.unmodelled_types(_records(spark, sf), _RULES)


@query("parsed_counts", f"""WITH {_RECORDS_CTE} SELECT entity_type, count(*) AS parsed
FROM w GROUP BY 1""")
def parsed_counts(spark, sf):
    return V.parsed_counts(_records(spark, sf))


_MAIL = r"[\w.+-]+@[\w-]+\.[\w.]+\w"


@query("personal_contacts", rf"""SELECT doc_id, email FROM (SELECT doc_id,
  unnest(regexp_extract_all(text, '{_MAIL}')) AS email FROM documents)
WHERE lower(string_split(email, '@')[-1]) IN ('gmail.com', 'mail2.example.com', 'mail5.example.com')""")
def personal_contacts(spark, sf):
    d = load_table(spark, sf, "documents")
    mails = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)))
                     .alias("email"))
    return V.personal_contacts(mails, ["gmail.com", "mail2.example.com", "mail5.example.com"])


# --- matching ----------------------------------------------------------------------------

def registry(spark, sf):
    """Page headings as the registry: slug from the page id, the title as alias."""
    return B.page_texts(spark, sf).filter(F.col("heading") != "").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("slug"),
        F.col("heading").alias("name"), F.array("title").alias("aliases"),
        F.col("page_id").alias("ord"))


def names(spark, sf):
    """Lead sentences as source names; English ones are cut off the registry's casing."""
    t = B.page_texts(spark, sf)
    return t.select("page_id", F.when(F.contains("url", F.lit("/en/")), F.upper("lead"))
                    .when(F.contains("url", F.lit("/de/")), F.col("heading"))
                    .otherwise(F.col("lead")).alias("name"))


REGISTRY_SQL = B.PAGE_TEXTS_SQL + """, registry AS (
  SELECT 'page-' || page_id AS slug, heading AS name, title AS alias, page_id AS ord
  FROM page_texts WHERE heading <> ''), names AS (
  SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN upper(lead) WHEN url LIKE '%/de/%' THEN heading
    ELSE lead END AS name FROM page_texts), candidates AS (
  SELECT name AS candidate, slug, ord FROM registry UNION ALL
  SELECT alias, slug, ord FROM registry UNION ALL SELECT slug, slug, ord FROM registry)"""
EXACT_SQL = """exact AS (SELECT candidate, arg_min(slug, ord) AS slug FROM candidates
  WHERE candidate <> '' GROUP BY 1)"""
NORMALIZED_SQL = f"""normalized AS (SELECT {normal_sql("candidate")} AS candidate,
  arg_min(slug, ord) AS slug FROM candidates WHERE {normal_sql("candidate")} <> '' GROUP BY 1)"""


@query("match_exact", f"""WITH {REGISTRY_SQL}, {EXACT_SQL}
SELECT page_id, n.name, slug AS match_slug FROM names n
LEFT JOIN exact ON trim(n.name) = candidate""")
def match_exact(spark, sf):
    return M.match_exact(names(spark, sf), registry(spark, sf))


@query("match_normalized", f"""WITH {REGISTRY_SQL}, {NORMALIZED_SQL}
SELECT page_id, n.name, slug AS match_slug FROM names n
LEFT JOIN normalized ON {normal_sql("n.name")} = candidate""")
def match_normalized(spark, sf):
    return M.match_normalized(names(spark, sf), registry(spark, sf))


@query("trigram_similarity", f"""WITH {B.PAGE_TEXTS_SQL}, g AS (
  SELECT page_id, {grams_sql("heading")} AS a, {grams_sql("lead")} AS b FROM page_texts)
SELECT page_id, round(coalesce({similarity_sql("a", "b")}, 0), 6) AS similarity FROM g""")
def trigram_similarity(spark, sf):
    return B.page_texts(spark, sf).select("page_id", F.round(X.trigram_similarity(
        F.col("heading"), F.col("lead")), 6).alias("similarity"))


_FUZZY_SQL = f"""e AS (SELECT name, arg_min(slug, ord) AS slug, min(ord) AS ord
  FROM registry GROUP BY 1), eg AS (SELECT *, {grams_sql("name")} AS g FROM e),
ng AS (SELECT DISTINCT name, {grams_sql("name")} AS g FROM names),
scored AS (SELECT ng.name, eg.slug, eg.ord, {similarity_sql("ng.g", "eg.g")} AS score FROM ng, eg),
fuzzy AS (SELECT name, slug, score FROM scored WHERE score >= {K.TRIGRAM_THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ord, slug) = 1)"""


@query("match_trigram", f"""WITH {REGISTRY_SQL}, {_FUZZY_SQL}
SELECT name, slug AS match_slug, round(score, 6) AS score FROM fuzzy""")
def match_trigram(spark, sf):
    return M.match_trigram(names(spark, sf), registry(spark, sf)).withColumn(
        "score", F.round("score", 6))


_RESOLVED_SQL = f"""{REGISTRY_SQL}, {EXACT_SQL}, {NORMALIZED_SQL}, {_FUZZY_SQL}, resolved AS (
  SELECT page_id, n.name, coalesce(x.slug, m.slug, f.slug) AS match_slug,
    CASE WHEN x.slug IS NOT NULL THEN 'exact' WHEN m.slug IS NOT NULL THEN 'normalized'
      WHEN f.slug IS NOT NULL THEN 'trigram' ELSE 'unmatched' END AS match_method,
    CASE WHEN x.slug IS NULL AND m.slug IS NULL THEN round(f.score, 6) END AS match_score
  FROM names n LEFT JOIN exact x ON trim(n.name) = x.candidate
    LEFT JOIN normalized m ON {normal_sql("n.name")} = m.candidate
    LEFT JOIN fuzzy f ON n.name = f.name)"""


@query("resolve_names", f"WITH {_RESOLVED_SQL} SELECT * FROM resolved")
def resolve_names(spark, sf):
    return M.resolve_names(names(spark, sf), registry(spark, sf)).withColumn(
        "match_score", F.round("match_score", 6))


@query("unmatched_report", f"""WITH {_RESOLVED_SQL}
SELECT {B.LANG_SQL} AS site, r.name AS source_name, url AS source_url
FROM resolved r JOIN pages p ON p.page_id = r.page_id WHERE match_slug IS NULL""")
def unmatched_report(spark, sf):
    pages = B.pages(spark, sf).select(F.col("page_id").alias("source_id"), "url")
    offers = M.resolve_names(names(spark, sf), registry(spark, sf)).select(
        F.col("page_id").alias("source_id"), F.col("match_slug").alias("program_slug"),
        F.col("name").alias("source_name")).join(pages.select("source_id", F.regexp_extract(
            "url", r"^[a-z]+://[^/?#]+/([a-z]+)/", 1).alias("site")), "source_id")
    return M.unmatched(offers, pages).select("site", "source_name", "source_url")


@query("did_you_mean", f"""WITH {REGISTRY_SQL}, q AS (SELECT DISTINCT text AS query,
  {grams_sql("text")} AS g FROM benchmark), d AS (SELECT slug, {grams_sql("name")} AS n,
  {grams_sql("alias")} AS a FROM registry), s AS (SELECT query, slug,
  greatest(coalesce({similarity_sql("g", "n")}, 0), coalesce({similarity_sql("g", "a")}, 0)) AS score
  FROM q, d)
SELECT query, slug, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query
  ORDER BY score DESC, slug) AS INTEGER) AS place FROM s WHERE score > {K.SUGGEST_THRESHOLD}
QUALIFY place <= {K.SUGGEST_LIMIT}""")
def did_you_mean(spark, sf):
    queries = load_table(spark, sf, "benchmark").select(F.col("text").alias("query"))
    dictionary = registry(spark, sf).withColumn("alias", F.get("aliases", F.lit(0)))
    return M.did_you_mean(queries, dictionary, ["name", "alias"]).withColumn(
        "score", F.round("score", 6))


@query("merge_by_key", """WITH m AS (SELECT p_brand, p_type, min(p_partkey) AS first_key,
  count(*) AS merged_rows, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1, 2),
i AS (SELECT p_brand, p_type, item, min((p_partkey, idx)) AS place FROM (
    SELECT p_brand, p_type, p_partkey, unnest(string_split(p_name, ' ')) AS item,
      generate_subscripts(string_split(p_name, ' '), 1) AS idx FROM part) GROUP BY 1, 2, 3)
SELECT m.p_brand, m.p_type, m.first_key, m.merged_rows, m.p_name,
  string_agg(item, ',' ORDER BY place) AS majors
FROM m JOIN i ON m.p_brand = i.p_brand AND m.p_type = i.p_type GROUP BY ALL""")
def merge_by_key(spark, sf):
    p = load_table(spark, sf, "part").select(
        "p_brand", "p_type", F.col("p_partkey").alias("first_key"), "p_name",
        F.split("p_name", " ").alias("majors"))
    return M.merge_by_key(p, ["p_brand", "p_type"], ["first_key"], ["majors"]).withColumn(
        "majors", F.array_join("majors", ","))


@query("attach_dimension", """SELECT s_suppkey, s_name, n_name, r_name FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def attach_dimension(spark, sf):
    suppliers = load_table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    placed = M.attach_dimension(suppliers, load_table(spark, sf, "nation"), "n_nationkey",
                                ["n_name", "n_regionkey"])
    regions = load_table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return M.attach_dimension(placed, regions, "n_regionkey", ["r_name"]).select(
        "s_suppkey", "s_name", "n_name", "r_name")


@query("sql_functions", f"""WITH {B.PAGE_TEXTS_SQL}, g AS (SELECT page_id, heading, lead,
  {grams_sql("heading")} AS a, {grams_sql("lead")} AS b FROM page_texts)
SELECT page_id, {slug_sql("heading")} AS slug, {normal_sql("heading")} AS normal_name,
  round(coalesce({similarity_sql("a", "b")}, 0), 6) AS similarity, 2 AS rank,
  {CLEAN_SQL.format(x="heading")} AS cleaned, heading || ', m' AS major,
  CAST(1 + page_id % 9 + 0.5 AS DECIMAL(3,1)) AS years, CAST(page_id % 50 AS INTEGER) AS days FROM g""")
def sql_functions_query(spark, sf):
    sql_functions.register(spark)
    B.page_texts(spark, sf).createOrReplaceTempView("attesta_page_texts")
    return spark.sql("""SELECT page_id, slugify(heading) AS slug,
      normalize_name(clean(heading)) AS normal_name,
      round(trigram_similarity(heading, lead), 6) AS similarity, conf_rank('high') AS rank,
      clean(heading) AS cleaned,
      try_element_at(majors_of(concat('BS majors in ', heading, ', m')), 1) AS major,
      years_of(concat(1 + page_id % 9, '.5 years')) AS years,
      staleness_days(timestamp'2026-06-01' - make_dt_interval(cast(page_id % 50 AS INT), 1),
                     timestamp'2026-06-01') AS days
      FROM attesta_page_texts""")


# --- page shapes -------------------------------------------------------------------------

_MENU = E.CardSpec(card=("li", None), title=("a", None))


@query("menu_offerings", rf"""WITH {_LI}, n AS (SELECT page_id, pos, {B.text_sql("card")} AS name
  FROM cards), s AS (SELECT *, {slug_sql("name")} AS slug FROM n), k AS (SELECT *, row_number() OVER (
  PARTITION BY page_id, slug ORDER BY pos) AS i FROM s WHERE name <> '' AND slug <> '')
SELECT page_id, pos, name AS source_name, slug, CAST(NULL AS VARCHAR) AS unit_slug, 'active' AS status
FROM k WHERE i = 1""")
def menu_offerings(spark, sf):
    records, _ = P.offerings_from_columns(B.pages(spark, sf), [], _MENU)
    return records.select("page_id", "pos", "source_name", "slug", "unit_slug", "status")


@query("menu_warnings", rf"""WITH {_LI}, n AS (SELECT page_id, pos, {B.text_sql("card")} AS name
  FROM cards), s AS (SELECT *, {slug_sql("name")} AS slug FROM n), k AS (SELECT *, row_number() OVER (
  PARTITION BY page_id, slug ORDER BY pos) AS i FROM s)
SELECT page_id, 'card with no title' AS warning FROM s WHERE name = '' UNION ALL
SELECT page_id, '"' || name || '" gives no slug' FROM s WHERE name <> '' AND slug = '' UNION ALL
SELECT page_id, 'duplicate on this page: ' || slug FROM k WHERE i > 1 AND slug <> '' UNION ALL
SELECT page_id, '"' || name || '" names no unit' FROM s WHERE name <> '' UNION ALL
SELECT page_id, 'no course cards found on this page' FROM pages
WHERE page_id NOT IN (SELECT page_id FROM s WHERE name <> '' AND slug <> '')""")
def menu_warnings(spark, sf):
    return P.offerings_from_columns(B.pages(spark, sf), [], _MENU)[1]


# Every page has blocks whose class names a unit of the list: that unit owns what they offer.
_OWNED = E.CardSpec(card=("div", None), title=None)


@query("owned_offerings", rf"""WITH b AS (SELECT page_id, unnest(list) AS card,
    generate_subscripts(list, 1) AS pos FROM (SELECT page_id, regexp_extract_all(
    regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?is)<div class="ad">.*?</div>') AS list FROM pages)),
n AS (SELECT page_id, pos, {B.text_sql("card")} AS name FROM b),
s AS (SELECT *, {slug_sql("name")} AS slug FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) AS i FROM s
  WHERE name <> '' AND slug <> '')
SELECT page_id, name AS source_name, slug, 'ad' AS unit_slug FROM k WHERE i = 1""")
def owned_offerings(spark, sf):
    records, _ = P.offerings_from_columns(B.pages(spark, sf), ["ad"], _OWNED)
    return records.filter(F.col("unit_slug").isNotNull()).select(
        "page_id", "source_name", "slug", "unit_slug")


@query("accordion_offerings", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, {CLEAN_SQL.format(x="line")} AS name FROM l),
s AS (SELECT *, {slug_sql("name")} AS slug FROM n WHERE name <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY i) AS r FROM s WHERE slug <> '')
SELECT doc_id AS page_id, name AS source_name, slug, 'u' || doc_id AS unit_slug FROM k WHERE r = 1""")
def accordion_offerings(spark, sf):
    url = F.concat(F.lit("https://h.org/courses/u"), F.col("page_id").cast("string"))
    records, _ = P.offerings_from_accordion(_accordions(spark, sf).withColumn("url", url))
    return records.select("page_id", "source_name", "slug", "unit_slug")


@query("anchor_units", rf"""WITH {ANCHORS_SQL}, s AS (SELECT page_id, pos,
  regexp_extract(a, 'title="([^"]*)"', 1) AS title, regexp_extract(a, 'href="([^"]*)"', 1) AS href
  FROM anchors), u AS (SELECT DISTINCT page_id, regexp_extract(href, '([^/]*)/*$', 1) AS slug
  FROM s WHERE href LIKE '/%')
SELECT page_id, 'unit without a name: ' || slug AS warning FROM u WHERE slug <> ''
UNION ALL SELECT page_id, 'no units found on this page' FROM pages""")
def anchor_units(spark, sf):
    """The pages' anchors carry no titles, so every unit is reported as unnamed, and no page has
    any."""
    return P.units_from_anchors(B.pages(spark, sf), "/")[1]


@query("described_units", rf"""WITH a AS (SELECT page_id, {B.text_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)")} AS name FROM pages)
SELECT page_id, name, 'U' || page_id AS abbreviation, 'About ' || name AS description FROM a WHERE name <> ''""")
def described_units(spark, sf):
    """Unit pages made of the pages' own headings, around a block that describes the unit."""
    pages = B.pages(spark, sf)
    name = E.text_of(F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1", 1))
    shown = F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    made = pages.select(
        "page_id", F.concat(F.lit("https://h.org/department/u"), "page_id").alias("url"),
        F.concat(F.lit('<div class="about-content"><h2 class="about-title">'), shown,
                 F.lit("</h2><p>About "), shown, F.lit("</p><p>more</p></div>")).alias("html"))
    return P.units_from_pages(made)[0].select("page_id", "name", "abbreviation", "description")
