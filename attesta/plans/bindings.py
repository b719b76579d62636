"""How the domain's tables are read off the given ones, in Spark and in SQL.

customer is the source registry and nation its site; an order is one sighting of the entity
(customer, priority). Orders before CUT are what is published, orders from CUT on are the batch
coming in. documents are snapshots: the first line names the page, doc_id orders deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import urls as U
from attesta.functions.hashing import content_hash
from attesta.operators import extract as E
from attesta.sources.scans import load_table as table

CUT = "1998-07-01"
NOW_TEXT = "2001-08-02 00:00:00"
EVENTS_NOW_TEXT = "2024-02-01 00:00:00"

ENTITY_BY_PRIORITY = {
    "1-URGENT": "announcement", "2-HIGH": "official", "3-MEDIUM": "program_offering",
    "4-NOT SPECIFIED": "document", "5-LOW": "scholarship",
}
METHOD_BY_SEGMENT = {
    "AUTOMOBILE": "crawl", "BUILDING": "manual", "FURNITURE": "seed", "HOUSEHOLD": "partner_feed",
    "MACHINERY": "crawl",
}
STATUS_BY_CODE = {"O": "active", "P": "suspended", "F": "phased_out"}
RUN_STATUS_BY_EVENT = {
    "purchase": "ok", "view": "ok", "click": "quarantined", "error": "failed",
    "signup": "running",
}
HTTP_BY_EVENT = {"click": 200, "view": 304, "purchase": 429, "error": 500, "signup": 404}


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def now() -> Column:
    return ts(NOW_TEXT)


def events_now() -> Column:
    return ts(EVENTS_NOW_TEXT)


def pick(mapping: dict, column: Column) -> Column:
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def case(mapping: dict, column: str) -> str:
    def text(value):
        return f"'{value}'" if isinstance(value, str) else str(value)
    arms = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in mapping.items())
    return f"CASE {column} {arms} END"


def day(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# --- sources and sightings ---------------------------------------------------------------

def sites(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.lower("n_name").alias("site"), F.col("n_nationkey").alias("site_key"),
        F.lower("r_name").alias("kind"))


SITES_SQL = """sites AS (
  SELECT lower(n_name) AS site, n_nationkey AS site_key, lower(r_name) AS kind
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    balance = F.col("c_acctbal")
    status = (F.when(balance < 0, "unavailable").when(balance < 500, "blocked")
              .when(balance < 1000, "suspended").when(balance > 9500, "retired")
              .otherwise("active"))
    return c.join(sites(spark, sf), c.c_nationkey == F.col("site_key")).select(
        F.col("c_custkey").cast("string").alias("source_id"), "site", F.col("c_name").alias("name"),
        F.concat(F.lit("https://"), "site", F.lit(".example.org/"), F.lower(
            F.replace("c_name", F.lit("#"), F.lit("-")))).alias("source_url"),
        pick(METHOD_BY_SEGMENT, F.col("c_mktsegment")).alias("method"),
        status.alias("source_status"), "c_acctbal")


SOURCES_SQL = SITES_SQL + f""", sources AS (
  SELECT CAST(c_custkey AS VARCHAR) AS source_id, site, c_name AS name,
    'https://' || site || '.example.org/' || lower(replace(c_name, '#', '-')) AS source_url,
    {case(METHOD_BY_SEGMENT, "c_mktsegment")} AS method,
    CASE WHEN c_acctbal < 0 THEN 'unavailable' WHEN c_acctbal < 500 THEN 'blocked'
      WHEN c_acctbal < 1000 THEN 'suspended' WHEN c_acctbal > 9500 THEN 'retired'
      ELSE 'active' END AS source_status, c_acctbal
  FROM customer JOIN sites ON c_nationkey = site_key)"""


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a sighting of an entity."""
    o = table(spark, sf, "orders")
    s = sources(spark, sf).select("source_id", "site")
    kind = pick(ENTITY_BY_PRIORITY, F.col("o_orderpriority"))
    rows = o.select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("source_id"),
        kind.alias("entity_type"), pick(STATUS_BY_CODE, F.col("o_orderstatus")).alias("status"),
        F.floor(F.col("o_totalprice") / 100000).cast("int").alias("band"),
        F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("seen_at"))
    return rows.join(s, "source_id").withColumn("owner", F.col("site")).withColumn(
        "slug", F.concat_ws("-", "source_id", "entity_type")).withColumn(
        "entity_ref", F.concat_ws("/", "site", "slug"))


SIGHTINGS_SQL = SOURCES_SQL + f""", sightings AS (
  SELECT o_orderkey AS pos, source_id, {case(ENTITY_BY_PRIORITY, "o_orderpriority")} AS entity_type,
    {case(STATUS_BY_CODE, "o_orderstatus")} AS status,
    CAST(floor(o_totalprice / 100000) AS INTEGER) AS band, o_totalprice AS total,
    o_orderdate AS seen_at, site, site AS owner,
    source_id || '-' || {case(ENTITY_BY_PRIORITY, "o_orderpriority")} AS slug,
    site || '/' || source_id || '-' || {case(ENTITY_BY_PRIORITY, "o_orderpriority")} AS entity_ref
  FROM orders JOIN sources ON CAST(o_custkey AS VARCHAR) = source_id)"""


def _latest(rows: DataFrame) -> DataFrame:
    keys = ["site", "slug"]
    rest = [c for c in rows.columns if c not in keys and c not in ("seen_at", "pos")]
    top = rows.groupBy(*keys).agg(F.max(F.struct("seen_at", "pos", *rest)).alias("_t"))
    return top.select(*keys, "_t.*")


def published(spark: SparkSession, sf: str) -> DataFrame:
    """Latest sighting of each entity before CUT, with the provenance columns."""
    rows = _latest(sightings(spark, sf).filter(F.col("seen_at") < ts(CUT)))
    return rows.select(
        "owner", "site", "slug", "entity_ref", "entity_type", "status", "band", "source_id",
        F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_verified_at"),
        F.lit("high").alias("confidence"), F.lit(0).alias("miss_count"))


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    """Latest sighting of each entity from CUT on."""
    return _latest(sightings(spark, sf).filter(F.col("seen_at") >= ts(CUT))).select(
        "owner", "site", "slug", "entity_ref", "entity_type", "status", "band", "source_id",
        "pos")


def parsed_sources(spark: SparkSession, sf: str) -> DataFrame:
    return sightings(spark, sf).filter(F.col("seen_at") >= ts(CUT)).select("source_id").distinct()


_LATEST_SQL = """SELECT * FROM sightings WHERE seen_at {op} TIMESTAMP '{cut}'
  QUALIFY row_number() OVER (PARTITION BY site, slug ORDER BY seen_at DESC, pos DESC) = 1"""

BATCH_SQL = SIGHTINGS_SQL + f""", published AS (
  {_LATEST_SQL.format(op="<", cut=CUT)}), incoming AS (
  {_LATEST_SQL.format(op=">=", cut=CUT)}), parsed AS (
  SELECT DISTINCT source_id FROM sightings WHERE seen_at >= TIMESTAMP '{CUT}')"""

CLASSIFIED_SQL = BATCH_SQL + """, classified AS (
  SELECT coalesce(i.site, c.site) AS site, coalesce(i.slug, c.slug) AS slug,
    coalesce(i.entity_type, c.entity_type) AS entity_type,
    coalesce(i.source_id, c.source_id) AS source_id,
    CASE WHEN i.slug IS NULL AND p.source_id IS NULL THEN 'untouched'
      WHEN i.slug IS NULL THEN 'missing' WHEN c.slug IS NULL THEN 'created'
      WHEN i.status <> c.status OR i.band <> c.band THEN 'updated' ELSE 'unchanged' END AS class,
    i.status AS new_status, c.status AS old_status, i.band AS new_band, c.band AS old_band,
    c.seen_at AS old_seen_at
  FROM incoming i FULL JOIN published c ON i.site = c.site AND i.slug = c.slug
    LEFT JOIN parsed p ON p.source_id = c.source_id)"""


# --- snapshots and pages -----------------------------------------------------------------

def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """documents as deliveries of the page named by their first line."""
    d = table(spark, sf, "documents")
    title = F.split("text", "\n", 2)[0]
    return d.select(
        content_hash(title).alias("source_id"), F.col("source").alias("owner"),
        F.col("doc_id").alias("snapshot_id"), F.col("doc_id").alias("fetched_at"),
        F.col("text").alias("body"), content_hash(F.col("text")).alias("content_hash"))


SNAPSHOTS_SQL = """snapshots AS (
  SELECT sha256(string_split(text, chr(10))[1]) AS source_id, source AS owner,
    doc_id AS snapshot_id, doc_id AS fetched_at, text AS body, sha256(text) AS content_hash
  FROM documents)"""


def delivery_chunk() -> Column:
    """Deliveries are windowed by ranges of their order, never by source alone."""
    return F.floor(F.col("fetched_at") / 100_000)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


PATH_SQL = r"regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1)"
HOST_SQL = r"regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
LANG_SQL = r"regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]+)/', 1)"


def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Title, heading and lead sentence of each page, as visible text."""
    p = pages(spark, sf)

    def between(start: str, end: str) -> Column:
        return E.text_of(F.regexp_extract("html", f"(?s){start}(.*?){end}", 1))

    return p.select("page_id", "url", between("<title>", "</title>").alias("title"),
                    between("<h1>", "</h1>").alias("heading"),
                    between("<p><b>", "<").alias("lead"),
                    between('<div class="ad">', "</div>").alias("caption"))


UNESCAPE_SQL = ("replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), "
                "'&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&')")


def text_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({UNESCAPE_SQL.format(x=bare)}, '\s+', ' ', 'g'))"


def _between_sql(start: str, end: str) -> str:
    return text_sql(f"regexp_extract(html, '(?s){start}(.*?){end}', 1)")


PAGE_TEXTS_SQL = f"""page_texts AS (
  SELECT page_id, url, {_between_sql("<title>", "</title>")} AS title,
    {_between_sql("<h1>", "</h1>")} AS heading, {_between_sql("<p><b>", "<")} AS lead,
    {_between_sql('<div class="ad">', "</div>")} AS caption FROM pages)"""


def robots_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A robots body per host, written out from the languages the host serves."""
    p = pages(spark, sf).select(U.host_of(F.col("url")).alias("host"), F.regexp_extract(
        "url", r"^[a-z]+://[^/?#]+/([a-z]+)/", 1).alias("lang"))
    h = p.groupBy("host").agg(F.min("lang").alias("first"), F.max("lang").alias("last"),
                              F.count(F.lit(1)).alias("n"))
    general = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /"), "first", F.lit("/\nAllow: /"), "first",
        F.lit("/*.html$\nCrawl-delay: "), F.col("n").cast("string"),
        F.lit("\nContent-Signal: Search=yes, ai-train="),
        F.when(F.col("first") == F.col("last"), "no").otherwise("yes"),
        F.lit("\nSitemap: /map.xml\n\nUser-agent: otherbot\nUser-agent: thirdbot\nDisallow: /\n"))
    named = F.concat(F.lit("\nUser-agent: AttestaBot\nDisallow: /"), "last", F.lit("/ # mine\n"))
    return h.select(
        "host", F.when(F.startswith("host", F.lit("m.")), F.lit("<html>404</html>")).when(
            F.startswith("host", F.lit("blog.")), F.concat(general, named))
        .otherwise(general).alias("body"))


HOSTS_SQL = f"""hosts AS (
  SELECT {HOST_SQL} AS host, min({LANG_SQL}) AS first, max({LANG_SQL}) AS last, count(*) AS n
  FROM pages GROUP BY 1)"""


# --- run log -----------------------------------------------------------------------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("run_id"), F.col("user_id").cast("string").alias("adapter"),
                    F.col("ts").cast("timestamp").alias("finished_at"),
                    pick(RUN_STATUS_BY_EVENT, F.col("event_type")).alias("status"), "value")


RUNS_SQL = f"""runs AS (
  SELECT event_id AS run_id, CAST(user_id AS VARCHAR) AS adapter, ts AS finished_at,
    {case(RUN_STATUS_BY_EVENT, "event_type")} AS status, value FROM events)"""


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """orders as a change log: each order rewrites two fields of its entity."""
    return sightings(spark, sf).select(
        F.col("pos").alias("id"), F.col("seen_at").alias("occurred_at"), "entity_type",
        "entity_ref", F.when(F.col("status") == "phased_out", "removed").otherwise("updated")
        .alias("operation"),
        F.create_map(
            F.lit("status"), F.struct(F.lit(None).cast("string").alias("from"),
                                      F.col("status").alias("to")),
            F.lit("band"), F.struct(F.lit(None).cast("string").alias("from"),
                                    F.col("band").cast("string").alias("to"))).alias("diff"))
