"""Queries over scans, sinks, admission and change gating."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import hashing as H
from attesta.functions import urls as U
from attesta.operators import admission as A
from attesta.operators import gate as G
from attesta.plans import bindings as B
from attesta.plans.registry import query
from attesta.session import work_path
from attesta.sources import scans, store


@query("scan_part", "SELECT * FROM part")
def scan_part(spark, sf):
    return scans.load_table(spark, sf, "part")


@query("scan_pages", """SELECT page_id, url, octet_length(encode(html)) AS byte_size,
  sha256(html) AS content_hash FROM pages""")
def scan_pages(spark, sf):
    return B.pages(spark, sf).select(
        "page_id", "url", F.octet_length("html").cast("bigint").alias("byte_size"),
        H.content_hash(F.col("html")).alias("content_hash"))


@query("captured_pages", """SELECT url, epoch(TIMESTAMP '2026-01-01') + page_id AS fetched_second,
  CAST(CASE WHEN page_id % 10 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
  'text/html; charset=utf-8' AS content_type, octet_length(encode(html)) AS byte_size,
  sha256(html) AS content_hash, 'ok' AS verdict FROM pages""")
def captured_pages(spark, sf):
    """The pages written as captured files, and scanned again."""
    root = work_path(spark, "captured")
    second = F.unix_timestamp(B.ts("2026-01-01")) + F.col("page_id")
    scans.capture_pages(scans.load_table(spark, sf, "pages").select(
        "url", F.timestamp_seconds(second).alias("fetched_at"),
        F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("html").cast("binary").alias("body")), root)
    return scans.load_captured(spark, root).select(
        "url", F.unix_timestamp("fetched_at").cast("double").alias("fetched_second"), "status",
        "content_type", "byte_size", H.content_hash(F.col("body")).alias("content_hash"), "verdict")


@query("scan_manifests", """SELECT source || '/' || doc_id AS url, sha256(text) AS sha256,
  lang AS content_type FROM documents""")
def scan_manifests(spark, sf):
    root = work_path(spark, "manifests")
    d = scans.load_table(spark, sf, "documents")
    entry = F.struct(
        F.col("doc_id").cast("string").alias("file"),
        F.concat_ws("/", "source", "doc_id").alias("url"),
        H.content_hash(F.col("text")).alias("sha256"), F.col("lang").alias("content_type"))
    d.select(F.array(entry).alias("files")).write.json(root)
    return scans.scan_manifests(spark, root, "*.json", multi_line=False).select(
        "url", "sha256", "content_type")


@query("verify_digests", r"""SELECT CAST(d.doc_id AS VARCHAR) AS path,
  CASE WHEN l.doc_id IS NULL THEN 'missing'
    WHEN sha256(trim(regexp_replace(d.text, '\s+', ' ', 'g'))) = sha256(d.text) THEN 'ok'
    ELSE 'mismatch' END AS verdict
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def verify_digests(spark, sf):
    from attesta.functions.text import clean
    d = scans.load_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), "text")
    kept = scans.load_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"))
    manifest = d.select("path", H.content_hash(clean(F.col("text"))).alias("sha256"))
    bodies = d.join(kept, "path", "left_semi").select("path", F.col("text").alias("content"))
    return scans.verify_digests(manifest, bodies).select("path", "verdict")


@query("store_snapshots", "WITH " + B.SNAPSHOTS_SQL + """, stored AS (
  SELECT DISTINCT owner, content_hash FROM snapshots
  WHERE snapshot_id IN (SELECT doc_id FROM labels))
SELECT s.owner || '/' || substr(s.content_hash, 1, 2) || '/' || s.content_hash AS storage_key,
  count(*) AS deliveries, max(octet_length(encode(s.body))) AS byte_size
FROM snapshots s LEFT JOIN stored t ON s.owner = t.owner AND s.content_hash = t.content_hash
WHERE t.owner IS NULL GROUP BY 1""")
def store_snapshots(spark, sf):
    snaps = B.snapshots(spark, sf)
    kept = scans.load_table(spark, sf, "labels").select(F.col("doc_id").alias("snapshot_id"))
    stored = store.with_storage_key(snaps.join(kept, "snapshot_id", "left_semi"))
    return store.store_snapshots(snaps, stored).select(
        "storage_key", "deliveries", F.col("byte_size").cast("bigint").alias("byte_size"))


@query("snapshot_log", """SELECT d.doc_id AS snapshot_id, CASE WHEN l.quality = 0 THEN 'failed'
  WHEN l.doc_id IS NULL THEN 'pending' WHEN l.toxic > 0 THEN 'ok_with_warnings' ELSE 'ok' END
  AS parse_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def snapshot_log(spark, sf):
    snaps = scans.load_table(spark, sf, "documents").select(F.col("doc_id").alias("snapshot_id"))
    outcomes = scans.load_table(spark, sf, "labels").select(
        F.col("doc_id").alias("snapshot_id"), F.col("toxic").alias("warnings"),
        F.when(F.col("quality") == 0, "low quality").alias("parse_error"))
    return store.snapshot_log(snaps, outcomes).select("snapshot_id", "parse_status")


NORMAL_SQL = (r"regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || "
              r"CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') = '' "
              r"THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') END || "
              r"regexp_extract(url, '^[^?#]*(\?[^#]+)?', 1)")


@query("normalize_url", f"SELECT page_id, {NORMAL_SQL} AS normal_url FROM pages")
def normalize_url(spark, sf):
    return B.pages(spark, sf).select("page_id", U.normalize_url(F.col("url")).alias("normal_url"))


@query("upsert_sources", f"""WITH known AS (
  SELECT {NORMAL_SQL} AS url, max({B.HOST_SQL}) AS domain FROM pages
  WHERE url LIKE 'https:%' GROUP BY 1), refs AS (
  SELECT {NORMAL_SQL} AS url, max({B.HOST_SQL}) AS domain FROM pages
  WHERE url NOT LIKE '%utm_source%' GROUP BY 1)
SELECT coalesce(r.url, k.url) AS url, coalesce(r.domain, k.domain) AS domain,
  CASE WHEN r.url IS NULL THEN 'seed' ELSE 'crawl' END AS method,
  CASE WHEN k.url IS NULL THEN 'active' WHEN k.domain LIKE 'm.%' THEN 'suspended'
    ELSE 'active' END AS status,
  CASE WHEN k.url IS NULL THEN 168 ELSE 24 END AS recrawl_hours
FROM refs r FULL JOIN known k ON r.url = k.url""")
def upsert_sources(spark, sf):
    p = B.pages(spark, sf).select("url", U.normalize_url(F.col("url")).alias("normal"),
                                  U.host_of(F.col("url")).alias("domain"))

    def registry(rows, method, hours):
        return rows.groupBy(F.col("normal").alias("url")).agg(
            F.max("domain").alias("domain")).select(
            "url", U.origin_of(F.col("url")).alias("origin"), "domain",
            F.lit(None).cast("string").alias("site"),
            F.array(F.lit("academic_unit")).alias("entity_types"),
            F.lit(method).alias("method"), F.lit(hours).alias("recrawl_hours"))

    known = registry(p.filter(F.startswith("url", F.lit("https:"))), "seed", 24).withColumn(
        "status", F.when(F.startswith("domain", F.lit("m.")), "suspended").otherwise("active"))
    refs = registry(p.filter(~F.contains("url", F.lit("utm_source"))), "crawl", None)
    refs = A.with_interval(refs)
    return G.upsert_sources(refs, known).select("url", "domain", "method", "status",
                                                "recrawl_hours")


@query("upsert_dimension", f"""WITH {B.SIGHTINGS_SQL}, seed AS (
  SELECT s.source_id, upper(s.name) AS name, s.method FROM sources s
  WHERE source_id IN (SELECT source_id FROM sightings WHERE seen_at >= TIMESTAMP '{B.CUT}'))
SELECT s.source_id, coalesce(d.name, s.name) AS name, s.method, s.source_status AS note
FROM sources s LEFT JOIN seed d ON s.source_id = d.source_id""")
def upsert_dimension(spark, sf):
    current = B.sources(spark, sf).select("source_id", "name", "method",
                                          F.col("source_status").alias("note"))
    seed = current.join(B.parsed_sources(spark, sf), "source_id", "left_semi").select(
        "source_id", F.upper("name").alias("name"), F.lit("seed").alias("method"))
    return store.upsert_dimension(seed, current, ["source_id"], keep=["method"],
                                  check=F.length("name") > 0)


@query("parse_diff", f"""WITH {B.BATCH_SQL}
SELECT coalesce(i.entity_type, p.entity_type) AS entity_type, coalesce(i.slug, p.slug) AS slug,
  CASE WHEN p.slug IS NULL THEN 'added' WHEN i.slug IS NULL THEN 'removed'
    WHEN i.band = p.band AND i.status = p.status THEN 'same' ELSE 'changed' END AS change
FROM incoming i FULL JOIN published p ON i.slug = p.slug AND i.entity_type = p.entity_type""")
def parse_diff(spark, sf):
    digest = H.record_hash(status=F.col("status"), band=F.col("band")).alias("record_hash")
    then = B.published(spark, sf).select("entity_type", "slug", digest)
    now = B.incoming(spark, sf).select("entity_type", "slug", digest)
    return store.parse_diff(then, now)


@query("replay_newest", "WITH " + B.SNAPSHOTS_SQL + """
SELECT source_id, max(snapshot_id) AS snapshot_id, arg_max(content_hash, snapshot_id)
  AS content_hash FROM snapshots GROUP BY 1""")
def replay_newest(spark, sf):
    return store.replay_set(B.snapshots(spark, sf)).select("source_id", "snapshot_id",
                                                           "content_hash")


@query("rebuild_as_of", """SELECT user_id, event_id, event_type FROM events
  WHERE ts <= TIMESTAMP '2024-01-16 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def rebuild_as_of(spark, sf):
    e = scans.load_table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("snapshot_id"),
        F.col("ts").cast("timestamp").alias("fetched_at"), "event_type")
    return store.snapshots_as_of(e, B.ts("2024-01-16 00:00:00")).select(
        F.col("source_id").alias("user_id"), F.col("snapshot_id").alias("event_id"), "event_type")


# --- admission ---------------------------------------------------------------------------

def _origins(spark, sf):
    """Hosts that serve more than one language count as known sites."""
    p = B.pages(spark, sf).select(U.host_of(F.col("url")).alias("site"), F.regexp_extract(
        "url", r"^[a-z]+://[^/?#]+/([a-z]+)/", 1).alias("lang"))
    return p.groupBy("site").agg(F.countDistinct("lang").alias("n")).filter("n > 1").select(
        "site", F.concat(F.lit("https://"), "site").alias("origin"))


@query("with_origin", f"""WITH {B.HOSTS_SQL}
SELECT page_id, {B.HOST_SQL} AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin,
  h.host AS site FROM pages LEFT JOIN hosts h ON h.host = {B.HOST_SQL} AND h.first <> h.last""")
def with_origin(spark, sf):
    return A.with_origin(B.pages(spark, sf), _origins(spark, sf)).select(
        "page_id", "host", "origin", "site")


@query("split_allowed", f"""WITH {B.HOSTS_SQL}
SELECT page_id, h.host IS NOT NULL AS allowed FROM pages
LEFT JOIN hosts h ON h.host = {B.HOST_SQL} AND h.first <> h.last""")
def split_allowed(spark, sf):
    kept, refused = A.split_allowed(B.pages(spark, sf), _origins(spark, sf))
    return kept.select("page_id", F.lit(True).alias("allowed")).unionByName(
        refused.select("page_id", F.lit(False).alias("allowed")))


# A takedown list: whole hosts, trees under any host, single shapes.
EXCLUDED = ["*/fr/*", "http://*.example.net/*", "https://m.*", "*utm_source=*", "*.html",
            "https://therin.example.net/en/*"]


def exclusions(spark):
    rows = [(pattern, i) for i, pattern in enumerate(EXCLUDED)]
    return spark.createDataFrame(rows, "pattern string, ord int")


_EXCLUDED_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(url, '{U.wildcard_to_regex(p)}') THEN '{p}'" for p in EXCLUDED) + " END"


@query("match_excluded", f"SELECT page_id, {_EXCLUDED_SQL} AS excluded_by FROM pages")
def match_excluded(spark, sf):
    return A.match_excluded(B.pages(spark, sf), exclusions(spark)).select("page_id", "excluded_by")


@query("robots_rules", f"""WITH {B.HOSTS_SQL}, r AS (
  SELECT host, 1 AS group_no, '*' AS agents, 'disallow' AS kind, '/' || first || '/' AS path,
    CAST(n AS DOUBLE) AS crawl_delay,
    'Search=yes, ai-train=' || CASE WHEN first = last THEN 'no' ELSE 'yes' END AS signal
  FROM hosts UNION ALL
  SELECT host, 1, '*', 'allow', '/' || first || '/*.html$', CAST(n AS DOUBLE),
    'Search=yes, ai-train=' || CASE WHEN first = last THEN 'no' ELSE 'yes' END FROM hosts
  UNION ALL SELECT host, 2, 'otherbot,thirdbot', 'disallow', '/', NULL, NULL FROM hosts
  UNION ALL SELECT host, 3, 'attestabot', 'disallow', '/' || last || '/', NULL, NULL FROM hosts
  WHERE host LIKE 'blog.%')
SELECT * FROM r WHERE host NOT LIKE 'm.%'""")
def robots_rules(spark, sf):
    return A.robots_rules(B.robots_bodies(spark, sf)).select(
        "host", F.col("group_no").cast("int").alias("group_no"),
        F.array_join("agents", ",").alias("agents"), "kind", "path", "crawl_delay", "signal")


@query("robots_decisions", f"""WITH {B.HOSTS_SQL}, u AS (
  SELECT page_id, {B.PATH_SQL} AS path, h.* FROM pages JOIN hosts h ON h.host = {B.HOST_SQL}),
d AS (SELECT *, host LIKE 'blog.%' AS named, host LIKE 'm.%' AS absent,
  starts_with(path, '/' || last || '/') AS own, starts_with(path, '/' || first || '/') AS general,
  ends_with(path, '.html') AS html FROM u)
SELECT page_id, host,
  CASE WHEN absent THEN true WHEN named THEN NOT own ELSE NOT general OR html END AS allowed,
  CASE WHEN absent THEN NULL WHEN named THEN CASE WHEN own THEN '/' || last || '/' END
    WHEN general AND html THEN '/' || first || '/*.html$'
    WHEN general THEN '/' || first || '/' END AS rule,
  CASE WHEN NOT absent AND NOT named THEN CAST(n AS DOUBLE) END AS crawl_delay FROM d""")
def robots_decisions(spark, sf):
    rules = A.robots_rules(B.robots_bodies(spark, sf))
    return A.robots_decisions(B.pages(spark, sf), rules, "AttestaBot").select(
        "page_id", "host", "allowed", "rule", "crawl_delay")


def _signals(spark, sf):
    rules = A.robots_rules(B.robots_bodies(spark, sf)).filter(F.col("signal").isNotNull())
    return rules.groupBy("host").agg(F.max("signal").alias("text")).select(
        "host", U.signal_map(F.col("text")).alias("signal"))


@query("signal_permits", f"""WITH {B.HOSTS_SQL}
SELECT host, 'yes' AS search, CASE WHEN first = last THEN 'no' ELSE 'yes' END AS ai_train,
  true AS permitted, first <> 'en' AS permitted_as_input FROM hosts WHERE host NOT LIKE 'm.%'""")
def signal_permits(spark, sf):
    first = B.pages(spark, sf).groupBy(U.host_of(F.col("url")).alias("host")).agg(F.min(
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([a-z]+)/", 1)).alias("first"))
    stated = F.map_concat("signal", F.create_map(
        F.lit("ai-input"), F.when(F.col("first") == "en", "no").otherwise("yes")))
    return _signals(spark, sf).join(first, "host").select(
        "host", F.col("signal")["search"].alias("search"),
        F.col("signal")["ai-train"].alias("ai_train"),
        U.signal_permits(F.col("signal")).alias("permitted"),
        U.signal_permits(stated).alias("permitted_as_input"))


@query("signal_drift", f"""WITH {B.HOSTS_SQL}
SELECT host, CASE WHEN first = last THEN 'use' ELSE 'ai-train,use' END AS changed_keys FROM hosts
WHERE host NOT LIKE 'm.%'""")
def signal_drift(spark, sf):
    current = _signals(spark, sf)
    stored = current.select("host", U.signal_map(F.lit("search=yes,ai-train=no,use=reference"))
                            .alias("signal"))
    return A.signal_drift(stored, current).select(
        "host", F.array_join("changed_keys", ",").alias("changed_keys"))


def _source_facts(spark, sf):
    """Each source with the entity types it feeds and when it was last read."""
    facts = B.sightings(spark, sf).groupBy("source_id").agg(
        F.sort_array(F.collect_set("entity_type")).alias("entity_types"),
        F.max("seen_at").alias("last_fetch_at"))
    return B.sources(spark, sf).join(facts, "source_id")


_FACTS_SQL = B.SIGHTINGS_SQL + f""", facts AS (
  SELECT s.source_id, s.method, s.source_url, s.source_status, s.site,
    {B.case(K.RECRAWL_HOURS, "min(g.entity_type)")} AS recrawl_hours,
    max(g.seen_at) AS last_fetch_at
  FROM sources s JOIN sightings g ON s.source_id = g.source_id GROUP BY ALL)"""


@query("recrawl_interval", f"WITH {_FACTS_SQL} SELECT source_id, recrawl_hours FROM facts")
def recrawl_interval(spark, sf):
    return A.with_interval(_source_facts(spark, sf)).select("source_id", "recrawl_hours")


_SINCE_SQL = f"floor((epoch(TIMESTAMP '{B.NOW_TEXT}') - epoch(last_fetch_at)) / 3600)"


@query("overdue_sources", f"""WITH {_FACTS_SQL}, due AS (
  SELECT *, {_SINCE_SQL} AS since, CASE WHEN method = 'manual' THEN {K.MANUAL_OVERDUE_DAYS * 24}
    ELSE recrawl_hours END AS allowed FROM facts)
SELECT source_id, CAST(floor((since - allowed) / 24) AS INTEGER) AS days_overdue,
  since >= 2 * allowed AS alert FROM due WHERE since > allowed""")
def overdue_sources(spark, sf):
    return A.overdue_sources(A.with_interval(_source_facts(spark, sf)), B.now()).select(
        "source_id", "days_overdue", "alert")


@query("source_report", f"""WITH {_FACTS_SQL}
SELECT source_url, site, method, source_status, {B.sql_day("last_fetch_at")} AS last_fetch_at,
  recrawl_hours, CAST(greatest(0, floor(({_SINCE_SQL} - CASE WHEN method = 'manual'
    THEN {K.MANUAL_OVERDUE_DAYS * 24} ELSE recrawl_hours END) / 24)) AS INTEGER) AS days_overdue
FROM facts""")
def source_report(spark, sf):
    facts = A.with_interval(_source_facts(spark, sf))
    return A.source_report(facts, B.now()).select(
        "source_url", "site", "method", "source_status", B.day("last_fetch_at").alias(
            "last_fetch_at"), "recrawl_hours", "days_overdue")


@query("page_budget", """WITH r AS (SELECT event_id, user_id, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, user_id, n <= 40 AS admitted, CASE WHEN n > 40 THEN 'maxPagesPerRun (40) reached'
  END AS error FROM r""")
def page_budget(spark, sf):
    e = scans.load_table(spark, sf, "events").select("event_id", "ts", "user_id")
    return A.apply_budget(e, ["ts", "event_id"], "user_id", 40).select(
        "event_id", "user_id", "admitted", "error")


@query("fetch_outcomes", f"""WITH a AS (SELECT user_id, event_id AS attempt,
  {B.case(B.HTTP_BY_EVENT, "event_type")} AS status FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, attempt AS attempts, status, CASE WHEN status = 304 THEN 'unchanged'
  WHEN status >= 400 THEN 'failed' ELSE 'fetched' END AS outcome,
  status >= 500 OR status = 429 AS retryable FROM a""")
def fetch_outcomes(spark, sf):
    e = scans.load_table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("attempt"),
        B.pick(B.HTTP_BY_EVENT, F.col("event_type")).alias("status"))
    return A.fetch_outcomes(e, "user_id")


@query("probe_status", f"""WITH p AS (SELECT page_id,
  CASE WHEN url LIKE 'https:%' THEN 200 ELSE 503 END AS status,
  regexp_matches(url, '(?i)/cgi-sys/suspendedpage\\.cgi|suspended') AS bad_url,
  regexp_matches(html, '(?i)suspended|coming soon|under construction|parked') AS bad_body,
  octet_length(encode(html)) <= {K.LIVE_MIN_BYTES} AS small FROM pages)
SELECT page_id, CASE WHEN status <> 200 THEN 'unavailable' WHEN bad_url OR bad_body
  THEN 'suspended' WHEN small THEN 'unavailable' ELSE 'active' END AS source_status,
  CASE WHEN status <> 200 THEN 'http ' || status WHEN bad_url THEN 'suspension url'
    WHEN bad_body THEN 'suspension text' WHEN small THEN 'body too small' END AS probe_note
FROM p""")
def probe_status(spark, sf):
    p = B.pages(spark, sf).select(
        "page_id", F.col("url").alias("final_url"), F.col("html").alias("body"),
        F.when(F.startswith("url", F.lit("https:")), 200).otherwise(503).alias("status"))
    return A.probe_status(p).select("page_id", "source_status", "probe_note")


# --- hashing and gating ------------------------------------------------------------------

@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return scans.load_table(spark, sf, "documents").select(
        "doc_id", H.content_hash(F.col("text")).alias("content_hash"))


@query("record_hash", """SELECT p_partkey, sha256(to_json({'brand': p_brand, 'name': p_name,
  'size': p_size, 'type': p_type})) AS record_hash FROM part""")
def record_hash(spark, sf):
    return scans.load_table(spark, sf, "part").select("p_partkey", H.record_hash(
        type=F.col("p_type"), name=F.col("p_name"), size=F.col("p_size"),
        brand=F.col("p_brand")).alias("record_hash"))


@query("latest_snapshot", """SELECT source, doc_id, sha256(text) AS content_hash FROM documents
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1""")
def latest_snapshot(spark, sf):
    d = scans.load_table(spark, sf, "documents")
    return G.latest_snapshot(d, "source", "doc_id", "doc_id").select(
        "source", "doc_id", H.content_hash(F.col("text")).alias("content_hash"))


def gated(spark, sf):
    """Unlabelled documents fetched against the labelled ones already stored."""
    snaps = B.snapshots(spark, sf).drop("body")
    kept = scans.load_table(spark, sf, "labels").select(F.col("doc_id").alias("snapshot_id"))
    stored = snaps.join(kept, "snapshot_id", "left_semi")
    fetched = snaps.join(kept, "snapshot_id", "left_anti")
    langs = scans.load_table(spark, sf, "documents").select(
        F.col("doc_id").alias("snapshot_id"), F.col("lang") != "de", F.col("n_chars")).toDF(
        "snapshot_id", "allowed", "n_chars")
    fetched = fetched.join(langs, "snapshot_id").withColumn(
        "http_status", F.when(F.col("n_chars") < 100, 404).otherwise(200))
    return G.gate(fetched, G.latest_hash(stored))


GATED_SQL = B.SNAPSHOTS_SQL + """, stored AS (
  SELECT source_id, arg_max(content_hash, snapshot_id) AS previous_hash FROM snapshots
  WHERE snapshot_id IN (SELECT doc_id FROM labels) GROUP BY 1), gated AS (
  SELECT s.snapshot_id, s.source_id, s.owner, s.content_hash,
    CASE WHEN d.n_chars < 100 THEN 404 ELSE 200 END AS http_status,
    CASE WHEN d.lang = 'de' THEN 'blocked' WHEN d.n_chars < 100 THEN 'failed'
      WHEN t.previous_hash = s.content_hash THEN 'unchanged' ELSE 'fetched' END AS gate
  FROM snapshots s JOIN documents d ON d.doc_id = s.snapshot_id
    LEFT JOIN stored t ON t.source_id = s.source_id
  WHERE s.snapshot_id NOT IN (SELECT doc_id FROM labels))"""


@query("content_gate", "WITH " + GATED_SQL + " SELECT snapshot_id, gate FROM gated")
def content_gate(spark, sf):
    return gated(spark, sf).select("snapshot_id", "gate")


@query("gate_counts", "WITH " + GATED_SQL + """ SELECT owner, count(*) AS discovered,
  count(*) FILTER (gate = 'fetched') AS fetched, count(*) FILTER (gate = 'unchanged') AS unchanged,
  count(*) FILTER (gate = 'failed') AS failed, count(*) FILTER (gate = 'excluded') AS excluded,
  count(*) FILTER (gate = 'blocked') AS blocked FROM gated GROUP BY 1""")
def gate_counts(spark, sf):
    return G.gate_counts(gated(spark, sf))


@query("gate_history", "WITH " + B.SNAPSHOTS_SQL + """, h AS (SELECT snapshot_id, content_hash,
  lag(content_hash) OVER (PARTITION BY source_id ORDER BY fetched_at) AS previous_hash
  FROM snapshots)
SELECT snapshot_id, previous_hash, CASE WHEN content_hash = previous_hash THEN 'unchanged'
  ELSE 'fetched' END AS gate FROM h""")
def gate_history(spark, sf):
    snaps = B.snapshots(spark, sf).drop("body")
    return G.gate_history(snaps, B.delivery_chunk()).select("snapshot_id", "previous_hash", "gate")


@query("mark_verified", f"""WITH {B.BATCH_SQL}, quiet AS (
  SELECT source_id FROM sources WHERE source_id NOT IN (SELECT source_id FROM parsed))
SELECT slug, {B.sql_day(f"CASE WHEN q.source_id IS NULL THEN p.seen_at ELSE TIMESTAMP '{B.NOW_TEXT}' END")}
  AS last_verified_at, CASE WHEN q.source_id IS NULL THEN 1 ELSE 0 END AS miss_count, status
FROM published p LEFT JOIN quiet q ON p.source_id = q.source_id""")
def mark_verified(spark, sf):
    quiet = B.sources(spark, sf).select("source_id").join(
        B.parsed_sources(spark, sf), "source_id", "left_anti")
    rows = B.published(spark, sf).withColumn("miss_count", F.lit(1))
    return G.mark_verified(rows, quiet, B.now()).select(
        "slug", B.day("last_verified_at").alias("last_verified_at"), "miss_count", "status")


@query("touch_sources", f"""WITH {GATED_SQL}, last AS (
  SELECT source_id, arg_max(gate, snapshot_id) AS gate,
    arg_max(http_status, snapshot_id) AS http_status FROM gated GROUP BY 1)
SELECT s.source_id, CASE WHEN gate = 'blocked' THEN 'blocked' WHEN gate IN ('fetched', 'unchanged')
    THEN 'active' ELSE 'suspended' END AS status,
  CASE WHEN gate IN ('fetched', 'unchanged') THEN http_status END AS last_status_code,
  gate IN ('fetched', 'unchanged') IS TRUE AS looked_at, (gate = 'fetched') IS TRUE AS changed,
  (gate IS DISTINCT FROM 'blocked') AS crawl_enabled
FROM (SELECT DISTINCT source_id FROM snapshots) s LEFT JOIN last USING (source_id)""")
def touch_sources(spark, sf):
    registry = B.snapshots(spark, sf).select("source_id").distinct().select(
        "source_id", F.lit("suspended").alias("status"),
        F.lit(None).cast("timestamp").alias("last_fetch_at"),
        F.lit(None).cast("timestamp").alias("last_change_at"),
        F.lit(None).cast("int").alias("last_status_code"), F.lit(True).alias("crawl_enabled"))
    last = gated(spark, sf).groupBy("source_id").agg(
        F.max(F.struct("snapshot_id", "gate", "http_status")).alias("_t")).select(
        "source_id", "_t.gate", "_t.http_status")
    return G.touch_sources(registry, last, B.now()).select(
        "source_id", "status", "last_status_code",
        F.col("last_fetch_at").isNotNull().alias("looked_at"),
        F.col("last_change_at").isNotNull().alias("changed"), "crawl_enabled")
