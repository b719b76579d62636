"""Queries over confidence, freshness, coverage and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import confidence as C
from attesta.functions import text as X
from attesta.operators import catalog as I
from attesta.operators import freshness as H
from attesta.operators import match as M
from attesta.plans import bindings as B
from attesta.plans.registry import query
from attesta.sources.scans import load_table


def entities(spark, sf):
    """The newest sighting of every entity, stored as high, with its edition."""
    rows = B._latest(B.sightings(spark, sf))
    return rows.select(
        "site", "source_id", "entity_type", "entity_ref", "status", "total",
        F.lit("high").alias("confidence"), F.col("seen_at").alias("last_verified_at"),
        (F.col("status") == "phased_out").alias("is_superseded"),
        F.when(F.col("band") >= 3, F.col("seen_at") - F.expr("INTERVAL '800' DAY"))
        .alias("effective_date"))


def scored(spark, sf):
    """Entities with staleness and recomputed confidence."""
    table, _ = H.decay(entities(spark, sf), B.sources(spark, sf), B.now())
    return table.withColumn("staleness_days", C.staleness_days(
        F.col("last_verified_at"), B.now()))


_AGE = f"datediff('day', last_verified_at, TIMESTAMP '{B.NOW_TEXT}')"
_EDITION = f"epoch(TIMESTAMP '{B.NOW_TEXT}') - epoch(effective_date) > {K.OLD_EDITION_DAYS} * 86400"
_RANK = {"low": 0, "medium": 1, "high": 2}


def _rank_case(mapping, column):
    return B.case({k: _RANK[v] for k, v in mapping.items()}, column)


ENTITIES_SQL = B.SIGHTINGS_SQL + f""", latest AS (SELECT * FROM sightings
  QUALIFY row_number() OVER (PARTITION BY site, slug ORDER BY seen_at DESC, pos DESC) = 1),
entities AS (SELECT l.site, l.source_id, entity_type, entity_ref, status, total,
  'high' AS old_confidence, seen_at AS last_verified_at, status = 'phased_out' AS is_superseded,
  CASE WHEN band >= 3 THEN seen_at - INTERVAL 800 DAY END AS effective_date,
  s.method, s.source_status, s.source_url
  FROM latest l JOIN sources s ON s.source_id = l.source_id),
ranked AS (SELECT *, CAST({_AGE} AS INTEGER) AS staleness_days,
  least({_rank_case(K.BASE_BY_METHOD, "method")},
    coalesce({_rank_case(K.CAP_BY_ENTITY, "entity_type")}, 2)) AS base,
  {B.case(K.DECAY_TO_LOW, "entity_type")} AS to_low,
  {B.case(K.DECAY_TO_MEDIUM, "entity_type")} AS to_medium FROM entities),
decayed AS (SELECT *, CASE WHEN staleness_days >= to_low THEN 0
  WHEN staleness_days >= to_medium THEN least(base, 1) ELSE base END AS aged FROM ranked),
scored AS (SELECT *, CASE WHEN entity_type = 'document' AND (is_superseded OR
    ({_EDITION}) IS TRUE) THEN 0
  WHEN source_status IN ('unavailable', 'blocked') THEN least(aged, 1) ELSE aged END AS rank
  FROM decayed),
final AS (SELECT *, CASE rank WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
  FROM scored)"""


@query("staleness_days", f"""SELECT o_orderkey, CAST(greatest(0, datediff('day', o_orderdate,
  TIMESTAMP '2000-01-01')) AS INTEGER) AS staleness_days FROM orders""")
def staleness_days(spark, sf):
    return load_table(spark, sf, "orders").select("o_orderkey", C.staleness_days(
        F.col("o_orderdate").cast("timestamp"), B.ts("2000-01-01")).alias("staleness_days"))


@query("lower_of", f"""SELECT l_orderkey, l_linenumber, {B.case({"A": 0, "N": 1, "R": 2}, "l_returnflag")}
  AS rank, CASE least({B.case({"A": 0, "N": 1, "R": 2}, "l_returnflag")},
  CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high'
  END AS lower_level FROM lineitem""")
def lower_of(spark, sf):
    a = B.pick({"A": "low", "N": "medium", "R": "high"}, F.col("l_returnflag"))
    b = B.pick({"F": "medium", "O": "high"}, F.col("l_linestatus"))
    return load_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", C.conf_rank(a).alias("rank"),
        C.lower_of(a, b).alias("lower_level"))


@query("confidence_scores", f"""WITH {ENTITIES_SQL}
SELECT entity_ref, staleness_days, confidence FROM final""")
def confidence_scores(spark, sf):
    return scored(spark, sf).select("entity_ref", "staleness_days", "confidence")


@query("unreachable_sources", f"""WITH {ENTITIES_SQL}
SELECT entity_ref, CASE WHEN entity_type = 'document' AND (is_superseded OR ({_EDITION}) IS TRUE)
    THEN 'low' WHEN source_status IN ('unavailable', 'blocked') AND staleness_days >= 30 THEN 'low'
  ELSE confidence END AS new_confidence FROM final""")
def unreachable_sources(spark, sf):
    down = entities(spark, sf).groupBy("source_id", "entity_ref").agg(
        F.max("last_verified_at").alias("unreachable_since"))
    rows = entities(spark, sf).join(down.select("entity_ref", "unreachable_since"), "entity_ref")
    return H.rescored(rows, B.sources(spark, sf), B.now()).select("entity_ref", "new_confidence")


@query("decay_events", f"""WITH {ENTITIES_SQL} SELECT entity_type, entity_ref,
  'updated' AS operation, old_confidence AS confidence_from, confidence AS confidence_to
FROM final WHERE confidence <> old_confidence""")
def decay_events(spark, sf):
    _, events = H.decay(entities(spark, sf), B.sources(spark, sf), B.now())
    change = F.col("diff")["confidence"]
    return events.select("entity_type", "entity_ref", "operation",
                         change["from"].alias("confidence_from"),
                         change["to"].alias("confidence_to"))


@query("min_confidence", f"""WITH {ENTITIES_SQL} SELECT entity_ref, confidence FROM final
WHERE rank >= 1""")
def min_confidence(spark, sf):
    return H.min_confidence(scored(spark, sf), "medium").select("entity_ref", "confidence")


_FRESH_SQL = f"""{B.sql_day("min(last_verified_at)")} AS oldest_verified_at,
  max(staleness_days) AS max_staleness_days, CASE min(rank) WHEN 0 THEN 'low' WHEN 1 THEN 'medium'
  ELSE 'high' END AS min_confidence, count(*) FILTER (rank = 2) AS n_high,
  count(*) FILTER (rank = 1) AS n_medium, count(*) FILTER (rank = 0) AS n_low"""


@query("freshness_overall", f"WITH {ENTITIES_SQL} SELECT {_FRESH_SQL} FROM final")
def freshness_overall(spark, sf):
    return H.freshness(scored(spark, sf)).withColumn(
        "oldest_verified_at", B.day("oldest_verified_at"))


@query("freshness_by_site", f"WITH {ENTITIES_SQL} SELECT site, {_FRESH_SQL} FROM final GROUP BY 1")
def freshness_by_site(spark, sf):
    return H.freshness(scored(spark, sf), "site").withColumn(
        "oldest_verified_at", B.day("oldest_verified_at"))


@query("freshness_report", f"""WITH {ENTITIES_SQL}
SELECT CASE grouping(site, entity_type) WHEN 3 THEN 'overall' WHEN 1 THEN 'site'
    ELSE 'entity_type' END AS scope, site, entity_type, count(*) AS rows,
  round(quantile_cont(staleness_days, 0.5), 6) AS median_staleness_days,
  round(quantile_cont(staleness_days, 0.95), 6) AS p95_staleness_days,
  count(*) FILTER (rank = 2) AS n_high, count(*) FILTER (rank = 1) AS n_medium,
  count(*) FILTER (rank = 0) AS n_low,
  round(coalesce(count(*) FILTER (rank = 2 AND entity_type <> 'scholarship') /
    nullif(count(*) FILTER (entity_type <> 'scholarship'), 0), 0), 6) AS pct_high
FROM final GROUP BY GROUPING SETS ((), (site), (entity_type))""")
def freshness_report(spark, sf):
    report = H.freshness_report(scored(spark, sf))
    shown = ["median_staleness_days", "p95_staleness_days", "pct_high"]
    return report.withColumns({c: F.round(c, 6) for c in shown})


@query("stalest_rows", f"""WITH {ENTITIES_SQL} SELECT site, entity_type, entity_ref, staleness_days,
  source_url FROM final QUALIFY row_number() OVER (PARTITION BY site
  ORDER BY staleness_days DESC, entity_type, entity_ref) = 1""")
def stalest_rows(spark, sf):
    facts = B.sources(spark, sf).select("source_id", "source_url")
    return H.stalest(scored(spark, sf).join(facts, "source_id"))


def _typed_tables(spark, sf):
    rows = entities(spark, sf)
    kinds = [*B.ENTITY_BY_PRIORITY.values(), "procedure"]
    return {k: rows.filter(F.col("entity_type") == k) for k in kinds}


_KINDS_SQL = "(VALUES " + ", ".join(f"('{k}')" for k in [*B.ENTITY_BY_PRIORITY.values(), "procedure"]) \
    + ") AS k(entity_type)"


@query("coverage", f"""WITH {ENTITIES_SQL} SELECT s.site, k.entity_type, count(f.entity_ref) AS rows
FROM sites s CROSS JOIN {_KINDS_SQL} LEFT JOIN final f ON f.site = s.site
  AND f.entity_type = k.entity_type GROUP BY 1, 2""")
def coverage(spark, sf):
    return H.coverage(_typed_tables(spark, sf), B.sites(spark, sf))


@query("coverage_wide", f"""WITH {ENTITIES_SQL} SELECT s.site,
  count(*) FILTER (entity_type = 'announcement') AS announcement,
  count(*) FILTER (entity_type = 'official') AS official,
  count(*) FILTER (entity_type = 'program_offering') AS program_offering,
  count(*) FILTER (entity_type = 'document') AS document,
  count(*) FILTER (entity_type = 'scholarship') AS scholarship,
  count(*) FILTER (entity_type = 'procedure') AS "procedure"
FROM sites s LEFT JOIN final f ON f.site = s.site GROUP BY 1""")
def coverage_wide(spark, sf):
    tables = _typed_tables(spark, sf)
    return H.coverage_wide(H.coverage(tables, B.sites(spark, sf)), list(tables))


@query("source_status", f"""WITH {B.SOURCES_SQL} SELECT site, count(*) AS total,
  count(*) FILTER (source_status = 'active') AS active,
  count(*) FILTER (source_status = 'blocked') AS blocked,
  count(*) FILTER (source_status IN ('unavailable', 'suspended', 'retired')) AS unavailable
FROM sources GROUP BY 1""")
def source_status(spark, sf):
    return H.source_status(B.sources(spark, sf))


@query("last_ok_run", f"""WITH {B.RUNS_SQL} SELECT adapter, {B.sql_day("max(finished_at)")}
  AS last_ingest_at FROM runs WHERE status = 'ok' GROUP BY 1""")
def last_ok_run(spark, sf):
    return H.last_ok_run(B.runs(spark, sf)).withColumn("last_ingest_at", B.day("last_ingest_at"))


_HOURS = f"floor(epoch(TIMESTAMP '{B.EVENTS_NOW_TEXT}') - epoch(max(finished_at) FILTER (status = 'ok'))) / 3600"


@query("ingest_health", f"""WITH {B.RUNS_SQL} SELECT
  {B.sql_day("max(finished_at) FILTER (status = 'ok')")} AS last_successful_ingest_at,
  round({_HOURS}, 1) AS hours_since_ingest,
  CASE WHEN {_HOURS} > {K.STALE_AFTER_HOURS} THEN 'degraded' ELSE 'ok' END AS health FROM runs""")
def ingest_health(spark, sf):
    return H.ingest_health(B.runs(spark, sf), B.events_now()).withColumn(
        "last_successful_ingest_at", B.day("last_successful_ingest_at"))


@query("check_freshness", f"""WITH {ENTITIES_SQL}, refs AS (
  SELECT DISTINCT site || '/' || source_id || '-document' AS entity_ref FROM sources)
SELECT r.entity_ref, staleness_days, confidence, source_url, source_status,
  {B.sql_day("last_verified_at")} AS last_verified_at
FROM refs r LEFT JOIN final f ON f.entity_ref = r.entity_ref""")
def check_freshness(spark, sf):
    refs = B.sources(spark, sf).select(F.concat(
        "site", F.lit("/"), "source_id", F.lit("-document")).alias("entity_ref"))
    return H.check_freshness(refs, scored(spark, sf), B.sources(spark, sf), B.now()).withColumn(
        "last_verified_at", B.day("last_verified_at"))


@query("assertion_policy", f"""WITH {ENTITIES_SQL}, p AS (SELECT entity_ref,
  entity_type IN ('scholarship', 'announcement') AS sensitive,
  rank = 0 OR staleness_days > 180 AS weak FROM final)
SELECT entity_ref, CASE WHEN sensitive AND weak THEN 'refuse' WHEN weak THEN 'caveat'
  WHEN sensitive THEN 'show_date' ELSE 'plain' END AS consumer_action FROM p""")
def assertion_policy(spark, sf):
    return H.with_assertion_policy(scored(spark, sf)).select("entity_ref", "consumer_action")


@query("with_provenance", f"""WITH {ENTITIES_SQL} SELECT entity_ref, source_url, method,
  staleness_days, confidence FROM final""")
def with_provenance(spark, sf):
    rows = scored(spark, sf).withColumn("first_seen_at", F.col("last_verified_at"))
    return H.with_provenance(rows, B.sources(spark, sf), B.now()).select(
        "entity_ref", "provenance.source_url", "provenance.method", "provenance.staleness_days",
        "provenance.confidence")


# --- catalogue ---------------------------------------------------------------------------

@query("list_sites", f"WITH {B.SITES_SQL} SELECT * FROM sites WHERE kind = 'asia'")
def list_sites(spark, sf):
    return I.list_sites(B.sites(spark, sf), kind="asia")


def units(spark, sf):
    """Suppliers as units of a site; the balance decides the kind."""
    s = load_table(spark, sf, "supplier")
    return s.join(B.sites(spark, sf), s.s_nationkey == F.col("site_key")).select(
        "site", F.col("s_suppkey").alias("unit_key"), F.col("s_name").alias("name"),
        F.concat_ws("/", "site", F.lower("s_name")).alias("ref"),
        F.when(F.col("s_acctbal") > 5000, "college").otherwise("department").alias("unit_type"),
        F.when(F.col("s_acctbal") > 0, "high").otherwise("low").alias("confidence"))


UNITS_SQL = B.SITES_SQL + """, units AS (SELECT site, s_suppkey AS unit_key, s_name AS name,
  site || '/' || lower(s_name) AS ref,
  CASE WHEN s_acctbal > 5000 THEN 'college' ELSE 'department' END AS unit_type,
  CASE WHEN s_acctbal > 0 THEN 'high' ELSE 'low' END AS confidence
  FROM supplier JOIN sites ON s_nationkey = site_key)"""


@query("list_units", f"""WITH {UNITS_SQL} SELECT ref, name, site FROM units
WHERE unit_type = 'college' AND confidence = 'high'""")
def list_units(spark, sf):
    return I.list_units(units(spark, sf), unit_type="college", floor="medium").select(
        "ref", "name", "site")


def programs(spark, sf):
    """Parts as programs."""
    return load_table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("name"),
        F.col("p_type").alias("level"), F.col("p_brand").alias("discipline"),
        F.array("p_name").alias("aliases"),
        (F.col("p_size") / 2).cast("decimal(3,1)").alias("typical_years"),
        F.when(F.col("p_size") > 10, "high").otherwise("low").alias("confidence"))


PROGRAMS_SQL = """programs AS (SELECT CAST(p_partkey AS VARCHAR) AS slug, p_name AS name,
  p_type AS level, p_brand AS discipline, p_size, CASE WHEN p_size > 10 THEN 'high' ELSE 'low' END
  AS confidence FROM part)"""


def offerings(spark, sf):
    """A part's lines at a supplier are its offerings; sites repeat, so the first line counts."""
    lines = load_table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("program_slug"), "l_suppkey",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").alias("line"))
    placed = lines.join(units(spark, sf).select("unit_key", "site", F.col("ref").alias("unit_ref")),
                        F.col("l_suppkey") == F.col("unit_key"))
    first = placed.groupBy("program_slug", "site").agg(F.min(F.struct("line", "unit_ref")).alias("_f"))
    flag = F.col("_f.line.l_returnflag")
    return first.select(
        "program_slug", "site", F.concat_ws("/", "site", "program_slug").alias("ref"),
        F.col("_f.unit_ref").alias("unit_ref"),
        B.pick({"A": "active", "N": "unknown", "R": "removed"}, flag).alias("status"),
        F.concat_ws("-", "_f.line.l_orderkey", "_f.line.l_linenumber").alias("source_name"),
        F.col("_f.line.l_suppkey").cast("string").alias("source_id"),
        F.lit("medium").alias("confidence"))


OFFERINGS_SQL = UNITS_SQL + """, offerings AS (SELECT CAST(l_partkey AS VARCHAR) AS program_slug,
  site, site || '/' || l_partkey AS ref, u.ref AS unit_ref,
  CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'N' THEN 'unknown' ELSE 'removed' END AS status,
  l_orderkey || '-' || l_linenumber AS source_name, CAST(l_suppkey AS VARCHAR) AS source_id,
  u.name AS unit_name, u.unit_type
  FROM lineitem JOIN units u ON l_suppkey = unit_key QUALIFY row_number() OVER (
    PARTITION BY l_partkey, site ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1)"""


@query("list_programs", f"""WITH {OFFERINGS_SQL}, {PROGRAMS_SQL} SELECT slug, name, level, discipline
FROM programs WHERE level = 'ECONOMY' AND name ILIKE '%re%' AND confidence = 'high' AND slug IN (
  SELECT program_slug FROM offerings WHERE site = 'nation_3' AND status = 'active')""")
def list_programs(spark, sf):
    return I.list_programs(programs(spark, sf), offerings(spark, sf), site="nation_3",
                           status="active", level="ECONOMY", q="re", floor="medium").select(
        "slug", "name", "level", "discipline")


def _supplier_sources(spark, sf):
    return units(spark, sf).select(
        F.col("unit_key").cast("string").alias("source_id"),
        F.concat(F.lit("https://"), "site", F.lit("/"), F.lower("name")).alias("source_url"),
        F.lit("crawl").alias("method"))


@query("list_offerings", f"""WITH {OFFERINGS_SQL}, {PROGRAMS_SQL} SELECT o.ref, o.program_slug,
  p.name AS program_name, unit_name, unit_type, 'https://' || o.site || '/' || lower(unit_name)
  AS source_url FROM offerings o LEFT JOIN programs p ON p.slug = o.program_slug
WHERE o.status = 'unknown'""")
def list_offerings(spark, sf):
    return I.list_offerings(offerings(spark, sf), _supplier_sources(spark, sf),
                            programs(spark, sf), units(spark, sf), status="unknown",
                            unmatched=False).select(
        "ref", "program_slug", "program_name", "unit_name", "unit_type", "source_url")


@query("program_with_offerings", f"""WITH {OFFERINGS_SQL}, {PROGRAMS_SQL} SELECT slug, name,
  count(ref) AS n, coalesce(string_agg(ref, ',' ORDER BY site), '') AS refs
FROM programs LEFT JOIN offerings ON program_slug = slug GROUP BY 1, 2""")
def program_with_offerings(spark, sf):
    nested = I.program_with_offerings(programs(spark, sf), offerings(spark, sf))
    return nested.select("slug", "name", F.size("offerings").cast("bigint").alias("n"),
                         F.array_join("offerings.ref", ",").alias("refs"))


@query("lookup_refs", f"""WITH {ENTITIES_SQL}, refs AS (SELECT site || '/' || source_id || '-' || k
  AS ref FROM sources, (VALUES ('document'), ('official')) AS t(k))
SELECT r.ref, f.entity_ref IS NOT NULL AS found FROM refs r LEFT JOIN final f
  ON f.entity_ref = r.ref""")
def lookup_refs(spark, sf):
    kinds = F.explode(F.array(F.lit("document"), F.lit("official")))
    refs = B.sources(spark, sf).select("site", "source_id", kinds.alias("k")).select(
        F.concat("site", F.lit("/"), "source_id", F.lit("-"), "k").alias("ref"))
    hits, misses = I.lookup(refs, entities(spark, sf).withColumnRenamed("entity_ref", "ref"))
    return hits.select("ref", F.lit(True).alias("found")).unionByName(
        misses.select("ref", F.lit(False).alias("found")))


@query("keyset_page", """SELECT p_partkey, p_name, true AS has_more,
  max(p_partkey) OVER () AS next_key FROM (SELECT * FROM part WHERE p_partkey > 57
  ORDER BY p_partkey LIMIT 20)""")
def keyset_page(spark, sf):
    return I.keyset_page(load_table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey",
                         57, 20)


@query("paginate_all", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1
  AS row_no, CAST(floor((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) / 20) AS BIGINT)
  AS page FROM orders""")
def paginate_all(spark, sf):
    return I.paginate_all(load_table(spark, sf, "orders").select("o_orderdate", "o_orderkey"),
                          ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("present_offering", f"""WITH {OFFERINGS_SQL} SELECT ref, program_slug AS program, unit_ref,
  unit_type, 0 AS majors, CAST(4.5 AS DOUBLE) AS years FROM offerings""")
def present_offering(spark, sf):
    placed = units(spark, sf).select(F.col("ref").alias("unit_ref"),
                                     F.col("name").alias("unit_name"), "unit_type")
    rows = offerings(spark, sf).join(placed, "unit_ref", "left").withColumns({
        "majors": F.lit(None).cast("array<string>"), "years": F.lit("4.5").cast("decimal(3,1)")})
    return I.present_offering(rows).select(
        "ref", "program", F.col("unit.ref").alias("unit_ref"), F.col("unit.type").alias("unit_type"),
        F.size("majors").alias("majors"), "years")


@query("present_program", """SELECT CAST(p_partkey AS VARCHAR) AS slug, p_name AS alias,
  p_size / 2.0 AS typical_years FROM part""".replace("p_size / 2.0", "CAST(p_size / 2 AS DOUBLE)"))
def present_program(spark, sf):
    return I.present_program(programs(spark, sf)).select(
        "slug", F.get("aliases", F.lit(0)).alias("alias"), "typical_years")


@query("contains_ci", """SELECT doc_id, text ILIKE '%THE MIT%' AS hit FROM documents""")
def contains_ci(spark, sf):
    return load_table(spark, sf, "documents").select(
        "doc_id", X.contains_ci(F.col("text"), "the mit").alias("hit"))


@query("select_fields", "SELECT l_orderkey, l_quantity FROM lineitem")
def select_fields(spark, sf):
    return I.select_fields(load_table(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"])


@query("change_feed_page", f"""WITH {B.SIGHTINGS_SQL} SELECT pos AS id, entity_ref,
  CASE WHEN status = 'phased_out' THEN 'removed' ELSE 'updated' END AS operation FROM sightings
WHERE entity_type = 'official' AND (seen_at > TIMESTAMP '1999-05-01' OR
  (seen_at = TIMESTAMP '1999-05-01' AND pos > 700)) ORDER BY seen_at, pos LIMIT 50""")
def change_feed_page(spark, sf):
    since = (B.ts("1999-05-01 00:00:00"), 700)
    return I.changes(B.change_log(spark, sf), since, "official", 50).select(
        "id", "entity_ref", "operation")


@query("list_announcements", f"""WITH {B.SIGHTINGS_SQL} SELECT pos, site, status FROM sightings
WHERE entity_type = 'announcement' AND site = 'nation_7' AND status = 'active'
  AND seen_at >= TIMESTAMP '1997-01-01' AND seen_at < TIMESTAMP '2000-01-01'""")
def list_announcements(spark, sf):
    rows = B.sightings(spark, sf).filter("entity_type = 'announcement'").select(
        "pos", "site", "status", F.col("status").alias("category"),
        F.col("seen_at").alias("published_at"), F.col("slug").alias("ref"))
    return I.list_announcements(rows, site="nation_7", category="active",
                                start=B.ts("1997-01-01"), end=B.ts("2000-01-01")).select(
        "pos", "site", "status")


@query("list_by_category", f"""WITH {ENTITIES_SQL} SELECT entity_ref, status FROM final
WHERE entity_type = 'scholarship' AND status = 'suspended' AND site = 'nation_11'""")
def list_by_category(spark, sf):
    return I.listing(entities(spark, sf), {"entity_type": "scholarship", "status": "suspended",
                                           "site": "nation_11"}).select("entity_ref", "status")


_WORD = "CAST(sum(CAST(('0x' || substr(d, {at}, 8)) AS BIGINT)) AS VARCHAR)"


@query("result_digest", f"""WITH r AS (SELECT sha256(to_json({{'n_name': n_name,
  'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}})) AS d FROM nation UNION ALL
  SELECT sha256(to_json({{'n_name': s_name, 'n_nationkey': s_nationkey, 'n_regionkey': s_suppkey}}))
  FROM supplier) SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || '-' ||
  {" || '-' || ".join(_WORD.format(at=1 + 8 * i) for i in range(8))}) AS fingerprint FROM r""")
def result_digest(spark, sf):
    n = load_table(spark, sf, "nation").withColumn("generated_at", F.lit("now"))
    s = load_table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("n_nationkey"), F.col("s_name").alias("n_name"),
        F.col("s_suppkey").alias("n_regionkey"), F.lit("then").alias("generated_at"))
    return I.result_digest(n.unionByName(s), "generated_at")


def _fees(spark, sf):
    """A line as a fee estimate: its price and its tax are the line items."""
    def item(label, amount):
        return F.struct(F.lit(label).alias("label"), amount.cast("decimal(12,2)").alias("amount"))
    items = F.to_json(F.array(item("price", F.col("l_extendedprice")),
                              item("quantity", F.col("l_quantity"))))
    return load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                    "l_suppkey", items.alias("line_items"))


@query("fee_totals", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE)
  AS total_estimate FROM lineitem""")
def fee_totals(spark, sf):
    return I.fee_totals(_fees(spark, sf)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("total_estimate").cast("double").alias("total_estimate"))


@query("procedure_steps", """SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1)
  AS INTEGER) AS n, lang AS title, unnest(string_split(text, chr(10))) AS detail FROM documents""")
def procedure_steps(spark, sf):
    steps = F.to_json(F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        (i + 1).alias("n"), F.col("lang").alias("title"), line.alias("detail"))))
    procedures = load_table(spark, sf, "documents").select("doc_id", steps.alias("steps"))
    return I.procedure_steps(procedures).select("doc_id", "n", "title", "detail")


@query("ordered_union", """WITH i AS (SELECT l_partkey, item, min(place) AS place FROM (
  SELECT l_partkey, l_returnflag AS item, (l_orderkey, l_linenumber, l_suppkey, 0) AS place
  FROM lineitem UNION ALL SELECT l_partkey, l_linestatus, (l_orderkey, l_linenumber, l_suppkey, 1)
  FROM lineitem) GROUP BY 1, 2)
SELECT l_partkey, string_agg(item, ',' ORDER BY place) AS flags FROM i GROUP BY 1""")
def ordered_union(spark, sf):
    rows = load_table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey",
        F.array("l_returnflag", "l_linestatus").alias("flags"))
    return M.distinct_in_order(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"],
                               "flags").withColumn("flags", F.array_join("flags", ","))
