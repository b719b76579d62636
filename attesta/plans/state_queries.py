"""Queries over reconcile, guard, publish, aliases, retention and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import confidence as C
from attesta.operators import freshness as H
from attesta.operators import lifecycle as L
from attesta.operators import reconcile as R
from attesta.operators import validate as V
from attesta.plans import bindings as B
from attesta.plans import ingest
from attesta.plans.registry import query
from attesta.session import materialize
from attesta.sources import store
from attesta.sources.scans import load_table

KEYS, FIELDS = ["site", "slug"], ["status", "band"]


def classified(spark, sf):
    return R.reconcile(B.incoming(spark, sf), B.published(spark, sf), KEYS, FIELDS,
                       B.parsed_sources(spark, sf))


def _entity_type():
    return F.coalesce("i.entity_type", "c.entity_type")


@query("scope_rows", f"""WITH {B.BATCH_SQL} SELECT slug FROM published
WHERE source_id IN (SELECT source_id FROM parsed)""")
def scope_rows(spark, sf):
    return R.scope(B.published(spark, sf), B.parsed_sources(spark, sf)).select("slug")


@query("reconcile_classes", f"WITH {B.CLASSIFIED_SQL} SELECT site, slug, class FROM classified")
def reconcile_classes(spark, sf):
    return classified(spark, sf).select("site", "slug", "class")


@query("field_diff", f"""WITH {B.CLASSIFIED_SQL}, d AS (
  SELECT slug, 'status' AS field, old_status AS old_value, new_status AS new_value
  FROM classified WHERE class = 'updated' AND old_status <> new_status UNION ALL
  SELECT slug, 'band', CAST(old_band AS VARCHAR), CAST(new_band AS VARCHAR)
  FROM classified WHERE class = 'updated' AND old_band <> new_band) SELECT * FROM d""")
def field_diff(spark, sf):
    return classified(spark, sf).filter("class = 'updated'").select(
        "slug", F.explode("diff").alias("field", "change")).select(
        "slug", "field", F.col("change.from").alias("old_value"),
        F.col("change.to").alias("new_value"))


def _expectations(spark, sf):
    """Every site is expected to give 100 to 400 rows of three entity types."""
    kinds = F.array(*[F.lit(k) for k in ("announcement", "document", "procedure")])
    return B.sites(spark, sf).select(
        F.col("site").alias("owner"), F.explode(kinds).alias("entity_type"),
        F.lit(20).alias("min_rows"), F.lit(400).alias("max_rows"))


def _counts(spark, sf):
    """This batch is what came in after 1999; types that were emitted span all of it."""
    emitted = B.incoming(spark, sf)
    late = emitted.join(B.sightings(spark, sf).filter(
        F.col("seen_at") >= B.ts("2000-10-01 00:00:00")).select("slug").distinct(), "slug",
        "left_semi")
    current = R.scope(B.published(spark, sf), B.parsed_sources(spark, sf))
    return R.guard_inputs(late, emitted, current, _expectations(spark, sf))


_COUNTS_SQL = B.BATCH_SQL + """, late AS (SELECT * FROM incoming WHERE slug IN (
  SELECT slug FROM sightings WHERE seen_at >= TIMESTAMP '2000-10-01 00:00:00')), types AS (
  SELECT owner, entity_type FROM incoming UNION
  SELECT owner, k FROM (SELECT DISTINCT owner FROM incoming),
    (VALUES ('announcement'), ('document'), ('procedure')) AS t(k)), counts AS (
  SELECT t.owner, t.entity_type,
    (SELECT count(*) FROM late l WHERE l.owner = t.owner AND l.entity_type = t.entity_type)
      AS incoming_count,
    (SELECT count(*) FROM published p WHERE p.owner = t.owner AND p.entity_type = t.entity_type
      AND p.source_id IN (SELECT source_id FROM parsed)) AS current_count,
    CASE WHEN t.entity_type IN ('announcement', 'document', 'procedure') THEN 20 END AS min_rows,
    CASE WHEN t.entity_type IN ('announcement', 'document', 'procedure') THEN 400 END AS max_rows
  FROM types t)"""


@query("guard_inputs", f"WITH {_COUNTS_SQL} SELECT * FROM counts")
def guard_inputs(spark, sf):
    return _counts(spark, sf)


def _guard_sql(full: bool) -> str:
    outside = """WHEN incoming_count < min_rows OR incoming_count > max_rows THEN 'count ' ||
      incoming_count || ' outside expected [' || min_rows || ',' || max_rows || '] for ' ||
      entity_type""" if full else ""
    skipped = "NULL" if full else """CASE WHEN min_rows IS NOT NULL THEN 'expectations [' ||
      min_rows || ',' || max_rows || '] not applied: incremental run' END"""
    return f"""verdicts AS (SELECT owner, entity_type, incoming_count, current_count, CASE {outside}
      WHEN current_count > 0 AND incoming_count = 0 THEN 'parser returned zero ' || entity_type
        || ' records where ' || current_count || ' existed'
      WHEN current_count >= 10 AND incoming_count < current_count * 0.7 THEN entity_type ||
        ' count dropped ' || current_count || '{R.ARROW}' || incoming_count || ' (>30%)'
      WHEN current_count >= 10 AND incoming_count > current_count * 2 THEN entity_type ||
        ' count doubled ' || current_count || '{R.ARROW}' || incoming_count END AS reason,
      CAST({skipped} AS VARCHAR) AS skipped FROM counts)"""


_VERDICT = """SELECT owner, entity_type, reason, skipped,
  CASE WHEN reason IS NULL THEN 'publish' ELSE 'quarantine' END AS action FROM verdicts"""


@query("guard_full", f"WITH {_COUNTS_SQL}, {_guard_sql(True)} {_VERDICT}")
def guard_full(spark, sf):
    return R.guard(_counts(spark, sf), "full").select("owner", "entity_type", "reason", "skipped",
                                                      "action")


@query("guard_incremental", f"WITH {_COUNTS_SQL}, {_guard_sql(False)} {_VERDICT}")
def guard_incremental(spark, sf):
    return R.guard(_counts(spark, sf)).select("owner", "entity_type", "reason", "skipped",
                                              "action")


@query("quarantine_payload", f"""WITH {_COUNTS_SQL}, {_guard_sql(False)}
SELECT i.owner, i.entity_type, i.slug, v.reason FROM incoming i JOIN verdicts v
  ON v.owner = i.owner AND v.entity_type = i.entity_type WHERE v.reason IS NOT NULL""")
def quarantine_payload(spark, sf):
    verdicts = materialize(R.guard(_counts(spark, sf)), "verdicts")
    batches, payload = R.quarantine_rows(verdicts, B.incoming(spark, sf), "r1")
    rows = payload.select("owner", "entity_type",
                          F.get_json_object("payload", "$.slug").alias("slug"))
    return rows.join(batches.select("owner", "entity_type", "reason"), ["owner", "entity_type"])


_LEVEL = "CASE entity_type WHEN 'official' THEN 'medium' WHEN 'document' THEN 'medium' " \
         "WHEN 'scholarship' THEN 'low' ELSE 'high' END"


@query("publish_state", f"""WITH {B.CLASSIFIED_SQL}
SELECT slug, CASE class WHEN 'created' THEN new_status WHEN 'updated' THEN new_status
    WHEN 'missing' THEN 'unknown' ELSE old_status END AS status,
  CASE WHEN class IN ('created', 'updated') THEN new_band ELSE old_band END AS band,
  CASE WHEN class = 'missing' THEN 1 ELSE 0 END AS miss_count,
  CASE WHEN class IN ('created', 'updated', 'unchanged') THEN {_LEVEL} ELSE 'high' END AS confidence,
  {B.sql_day(f"CASE WHEN class IN ('missing', 'untouched') THEN old_seen_at ELSE TIMESTAMP '{B.NOW_TEXT}' END")}
    AS last_verified_at,
  {B.sql_day(f"coalesce(old_seen_at, TIMESTAMP '{B.NOW_TEXT}')")} AS first_seen_at
FROM classified""")
def publish_state(spark, sf):
    level = C.confidence(F.lit("crawl"), _entity_type(), F.lit(0))
    state = R.publish(classified(spark, sf), B.published(spark, sf), level, B.now())
    return state.select("slug", "status", "band", "miss_count", "confidence",
                        B.day("last_verified_at").alias("last_verified_at"),
                        B.day("first_seen_at").alias("first_seen_at"))


_EVENTS_SQL = """SELECT entity_type, site || '/' || slug AS entity_ref,
  CASE class WHEN 'missing' THEN 'updated' ELSE class END AS operation,
  CASE WHEN class = 'missing' THEN old_status WHEN class = 'updated' AND old_status <> new_status
    THEN old_status END AS status_from,
  CASE WHEN class = 'missing' THEN 'unknown' WHEN class = 'updated' AND old_status <> new_status
    THEN new_status END AS status_to FROM classified WHERE class IN ('created', 'updated', 'missing')"""


@query("change_events", f"WITH {B.CLASSIFIED_SQL} {_EVENTS_SQL}")
def change_events(spark, sf):
    events = R.change_events(classified(spark, sf), F.concat_ws("/", *KEYS), _entity_type(), "r1",
                             B.now())
    status = F.try_element_at("diff", F.lit("status"))
    return events.select("entity_type", "entity_ref", "operation",
                         status["from"].alias("status_from"), status["to"].alias("status_to"))


@query("dry_run_counts", f"""WITH {B.CLASSIFIED_SQL} SELECT site,
  count(*) FILTER (class = 'created') AS created, count(*) FILTER (class = 'updated') AS updated,
  count(*) FILTER (class = 'unchanged') AS unchanged, count(*) FILTER (class = 'missing') AS missing,
  count(*) FILTER (class = 'untouched') AS untouched FROM classified GROUP BY 1""")
def dry_run_counts(spark, sf):
    return R.class_counts(classified(spark, sf), "site")


# Sightings fold into years as runs: a source is looked at in every year it has an order.
_MISSES_SQL = B.SIGHTINGS_SQL + """, y AS (SELECT source_id, slug, entity_type, year(seen_at) AS run_no
  FROM sightings), last AS (SELECT source_id, slug, max(run_no) AS last_run FROM y GROUP BY 1, 2),
misses AS (SELECT l.source_id, l.slug, l.last_run, CAST((SELECT count(DISTINCT y.run_no) FROM y
  WHERE y.source_id = l.source_id AND y.run_no > l.last_run) AS INTEGER) AS miss_count FROM last l)"""


def yearly(spark, sf):
    return B.sightings(spark, sf).select("source_id", F.col("slug").alias("ref"),
                                         F.year("seen_at").alias("run_no"))


@query("age_missing", f"""WITH {_MISSES_SQL} SELECT slug, miss_count + 1 AS miss_count,
  CASE WHEN miss_count + 1 >= 3 THEN 'removed' ELSE 'unknown' END AS status,
  CASE WHEN miss_count >= 3 THEN 'removed' WHEN miss_count >= 1 THEN 'unknown' ELSE 'active' END
    <> CASE WHEN miss_count + 1 >= 3 THEN 'removed' ELSE 'unknown' END AS changed FROM misses""")
def age_missing(spark, sf):
    from attesta.streaming.jobs import misses_from
    rows = yearly(spark, sf)
    counted = misses_from(rows, rows.select("source_id", "run_no"))
    return R.age_missing(counted).select(F.col("ref").alias("slug"), "miss_count", "status",
                                         "changed")


@query("run_summary", f"""WITH {B.CLASSIFIED_SQL}, g AS (SELECT owner, count(*) AS discovered,
  count(*) FILTER (source_id IN (SELECT source_id FROM parsed)) AS fetched,
  count(*) FILTER (source_id NOT IN (SELECT source_id FROM parsed)) AS unchanged_sources
  FROM (SELECT site AS owner, source_id FROM sources) GROUP BY 1), c AS (
  SELECT site AS owner, count(*) FILTER (class IN ('created', 'updated', 'unchanged')) AS published,
    count(*) FILTER (class = 'missing') AS missing FROM classified GROUP BY 1)
SELECT g.owner, discovered, fetched, unchanged_sources, coalesce(published, 0) AS published,
  coalesce(missing, 0) AS missing, 'ok' AS run_status FROM g LEFT JOIN c ON g.owner = c.owner""")
def run_summary(spark, sf):
    from attesta.operators import gate as G
    hit = B.parsed_sources(spark, sf).withColumn("_hit", F.lit(True))
    gated = B.sources(spark, sf).join(hit, "source_id", "left").select(
        F.col("site").alias("owner"), "source_id",
        F.when(F.col("_hit"), "fetched").otherwise("unchanged").alias("gate"))
    gates = G.gate_counts(gated).withColumnRenamed("unchanged", "unchanged_sources")
    classes = R.class_counts(classified(spark, sf), "site").withColumnRenamed("site", "owner")
    held = spark.createDataFrame([], "owner string")
    return store.run_summary(gates, classes, held, "r1").select(
        "owner", "discovered", "fetched", "unchanged_sources", "published", "missing",
        "run_status")


@query("run_sources", f"WITH {B.BATCH_SQL} SELECT DISTINCT site AS owner, source_id FROM incoming")
def run_sources(spark, sf):
    gated = B.incoming(spark, sf).select("owner", "source_id", F.lit("fetched").alias("gate"))
    return store.run_sources(gated, "r1").drop("run_id")


# Documents renamed: the same text (durable name) now filed under another source.
def _filed(spark, sf):
    d = load_table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("source_name"), "lang")
    labelled = load_table(spark, sf, "labels").select("doc_id")
    return d, labelled


def _moves(spark, sf):
    d, labelled = _filed(spark, sf)
    current = d.join(labelled, "doc_id", "left_semi").select(
        F.col("doc_id").cast("string").alias("slug"), "source_name")
    coming = d.join(labelled, "doc_id", "left_anti").select(
        F.col("doc_id").cast("string").alias("slug"), "source_name", F.col("doc_id").alias("pos"))
    # A record whose key is a published one keeps it; the others fall on the least copy.
    target = coming.groupBy("source_name").agg(F.min("pos").alias("pos")).select(
        "source_name", "pos", F.col("pos").cast("string").alias("slug"))
    return target, current


_MOVES_SQL = """cur AS (SELECT CAST(doc_id AS VARCHAR) AS slug, sha256(text) AS source_name
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
inc AS (SELECT sha256(text) AS source_name, min(doc_id) AS pos, CAST(min(doc_id) AS VARCHAR) AS slug
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1),
prior AS (SELECT source_name, max(slug) AS old_key FROM cur GROUP BY 1),
moves AS (SELECT old_key, slug AS new_key, 'rename' AS action FROM inc JOIN prior USING (source_name))"""


@query("renames", f"WITH {_MOVES_SQL} SELECT * FROM moves")
def renames(spark, sf):
    coming, current = _moves(spark, sf)
    return L.renames(coming, current)


# Several names lead to one key: every document of a source and language is merged into one.
_SUPERSEDE_SQL = """cur AS (SELECT 'doc-' || doc_id AS slug, sha256(text) AS source_name
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
inc AS (SELECT source || '-' || lang AS slug, sha256(text) AS source_name, min(doc_id) AS pos
  FROM documents GROUP BY 1, 2),
prior AS (SELECT source_name, max(slug) AS old_key FROM cur GROUP BY 1),
best AS (SELECT old_key, arg_min(slug, (pos, slug)) AS new_key, min(pos) AS pos
  FROM inc JOIN prior USING (source_name) GROUP BY 1),
moves AS (SELECT old_key, new_key, CASE WHEN row_number() OVER (
  PARTITION BY new_key ORDER BY pos, old_key) = 1 THEN 'rename' ELSE 'supersede' END AS action FROM best)"""


def _merges(spark, sf):
    d = load_table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("source_name"), F.concat_ws("-", "source", "lang")
        .alias("slug"))
    current = d.join(load_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    coming = d.select("slug", "source_name", F.col("doc_id").alias("pos"))
    return coming, current.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
                                  .alias("slug"), "source_name", F.lit("active").alias("status"))


@query("supersede", f"WITH {_SUPERSEDE_SQL} SELECT * FROM moves")
def supersede(spark, sf):
    coming, current = _merges(spark, sf)
    return L.renames(coming, current)


@query("apply_renames", f"""WITH {_SUPERSEDE_SQL}
SELECT coalesce(CASE WHEN action = 'rename' THEN new_key END, slug) AS slug,
  CASE WHEN action = 'supersede' THEN 'removed' ELSE 'active' END AS status
FROM cur LEFT JOIN moves ON old_key = slug""")
def apply_renames(spark, sf):
    coming, current = _merges(spark, sf)
    moves = materialize(L.renames(coming, current), "moves")
    return L.apply_renames(current, moves).select("slug", "status").unionByName(
        L.retire_superseded(current, moves).select("slug", "status"))


@query("move_events", f"""WITH {_SUPERSEDE_SQL}
SELECT CASE WHEN action = 'rename' THEN new_key ELSE old_key END AS entity_ref,
  CASE WHEN action = 'rename' THEN 'updated' ELSE 'removed' END AS operation,
  CASE WHEN action = 'rename' THEN 'ref' ELSE 'superseded_by' END AS field, new_key AS new_value
FROM moves""")
def move_events(spark, sf):
    events = L.move_events(L.renames(*_merges(spark, sf)), "r1", B.now())
    return events.select("entity_ref", "operation", F.explode("diff").alias("field", "change")
                         ).select("entity_ref", "operation", "field",
                                  F.col("change.to").alias("new_value"))


@query("purge_excluded", r"""SELECT page_id FROM pages WHERE NOT (
  regexp_matches(url, '^https://m\..*$') OR regexp_matches(url, '/fr/'))""")
def purge_excluded(spark, sf):
    patterns = spark.createDataFrame([("https://m.*", 0), ("*/fr/*", 1)], "pattern string, ord int")
    entities = B.pages(spark, sf).withColumnRenamed("url", "source_url")
    return L.purge(entities, patterns).select("page_id")


@query("retain_events", f"""SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderdate >= TIMESTAMP '{B.NOW_TEXT}' - INTERVAL 12 MONTH""")
def retain_events(spark, sf):
    return L.retain(B.change_log(spark, sf), B.now()).select("id")


@query("resume_status", f"""SELECT c_custkey, CASE WHEN max(o_orderdate) <
  TIMESTAMP '{B.NOW_TEXT}' - INTERVAL 12 MONTH THEN 'expired' ELSE 'ok' END AS resume
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def resume_status(spark, sf):
    last = load_table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").cast("timestamp").alias("since"))
    known = last.join(load_table(spark, sf, "customer"), "c_custkey", "left_semi")
    return known.select("c_custkey", L.resume_status(F.col("since"), B.now()).alias("resume"))


_ALIASES_SQL = """aliases AS (SELECT a.conv_id || '/' || a.turn AS old_ref,
  b.conv_id || '/' || b.turn AS new_ref FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _aliases(spark, sf):
    """Every turn of a conversation forwards to the next one."""
    c = load_table(spark, sf, "conversations").select("conv_id", "turn")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return c.join(after, ["conv_id", "turn"], "left_semi").select(
        F.concat_ws("/", "conv_id", "turn").alias("old_ref"),
        F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("new_ref"))


@query("resolve_aliases", f"""WITH RECURSIVE {_ALIASES_SQL}, walk AS (
  SELECT old_ref, new_ref AS final_ref, 1 AS hops FROM aliases UNION ALL
  SELECT w.old_ref, a.new_ref, hops + 1 FROM walk w JOIN aliases a ON a.old_ref = w.final_ref)
SELECT old_ref, arg_max(final_ref, hops) AS final_ref, CAST(max(hops) AS BIGINT) AS hops
FROM walk GROUP BY 1""")
def resolve_aliases(spark, sf):
    return L.resolve_aliases(_aliases(spark, sf))


_UNITS_SQL = """units AS (SELECT 'r' || r_regionkey AS ref, NULL AS parent_ref FROM region UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL
  SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


@query("unit_tree", f"""WITH RECURSIVE {_UNITS_SQL}, walk AS (
  SELECT ref, ref AS root, 0 AS depth FROM units WHERE parent_ref IS NULL UNION ALL
  SELECT u.ref, w.root, depth + 1 FROM walk w JOIN units u ON u.parent_ref = w.ref),
kids AS (SELECT parent_ref, count(*) AS n FROM units WHERE parent_ref IS NOT NULL GROUP BY 1)
SELECT w.ref, u.parent_ref, w.root, CAST(depth AS BIGINT) AS depth, coalesce(n, 0) AS children
FROM walk w JOIN units u ON u.ref = w.ref LEFT JOIN kids k ON k.parent_ref = w.ref""")
def unit_tree(spark, sf):
    def level(name, prefix, key, parent_prefix=None, parent=None):
        up = F.concat(F.lit(parent_prefix), F.col(parent).cast("string")) if parent else F.lit(
            None).cast("string")
        return load_table(spark, sf, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("ref"),
            up.alias("parent_ref"))
    units = level("region", "r", "r_regionkey").unionByName(
        level("nation", "n", "n_nationkey", "r", "n_regionkey")).unionByName(
        level("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(
        level("orders", "o", "o_orderkey", "c", "o_custkey"))
    return L.unit_tree(units)


_AS_OF = "2000-01-01 00:00:00"


@query("state_as_of", f"""WITH {B.SIGHTINGS_SQL}, known AS (SELECT * FROM sightings
  WHERE seen_at <= TIMESTAMP '{_AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY entity_ref ORDER BY seen_at DESC, pos DESC) = 1)
SELECT entity_ref, 'status' AS field, status AS value FROM known WHERE status <> 'phased_out'
UNION ALL SELECT entity_ref, 'band', CAST(band AS VARCHAR) FROM known
WHERE status <> 'phased_out'""")
def state_as_of(spark, sf):
    return L.state_as_of(B.change_log(spark, sf), B.ts(_AS_OF))


@query("fallback_keys", """WITH p AS (SELECT page_id,
  regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site,
  nullif(regexp_extract(url, '/([0-9]+)$', 1), '') AS source_key, url FROM pages)
SELECT page_id, CASE WHEN source_key IS NOT NULL THEN 'key/' || site || '/' || source_key
  ELSE 'slug/' || site || '/' || url END AS identity FROM p""")
def fallback_keys(spark, sf):
    p = B.pages(spark, sf).select(
        "page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("site"),
        F.nullif(F.regexp_extract("url", "/([0-9]+)$", 1), F.lit("")).alias("source_key"),
        F.col("url").alias("slug"))
    return R.with_key(p).select("page_id", "identity")


# --- whole runs --------------------------------------------------------------------------

def _run(spark, sf, entity_type):
    """A run over one entity type of all sites at once."""
    mine = F.col("entity_type") == entity_type
    coming, _ = V.validate(B.incoming(spark, sf).filter(mine), {entity_type: [
        V.one_of("status", K.OFFERING_STATUSES), V.in_range("band", -1, 5)]})
    table = B.published(spark, sf).filter(mine)
    none = spark.createDataFrame(
        [], "owner string, entity_type string, min_rows int, max_rows int")
    return ingest.plan(coming.drop("entity_type", "entity_ref"),
                       table.drop("entity_type", "entity_ref"), B.parsed_sources(spark, sf), none,
                       entity_type=entity_type, run_id="r1", now=B.now(), fields=FIELDS,
                       settle=True)


_HELD = """held AS (SELECT owner FROM (
    SELECT o.owner, o.n AS cur, coalesce(i.n, 0) AS inc FROM (
      SELECT owner, count(*) AS n FROM published WHERE entity_type = 'document'
        AND source_id IN (SELECT source_id FROM parsed) GROUP BY 1) o
    RIGHT JOIN (SELECT owner, count(*) AS n FROM incoming WHERE entity_type = 'document' GROUP BY 1) i
      ON o.owner = i.owner)
  WHERE cur >= 10 AND (inc < cur * 0.7 OR inc > cur * 2))"""


@query("run_next_state", f"""WITH {B.CLASSIFIED_SQL}, {_HELD}
SELECT slug, CASE WHEN site IN (SELECT owner FROM held) THEN old_status
    WHEN class IN ('created', 'updated') THEN new_status WHEN class = 'missing' THEN 'unknown'
    ELSE old_status END AS status,
  CASE WHEN class = 'missing' AND site NOT IN (SELECT owner FROM held) THEN 1 ELSE 0 END AS miss_count
FROM classified WHERE entity_type = 'document'
  AND NOT (class = 'created' AND site IN (SELECT owner FROM held))""")
def run_next_state(spark, sf):
    return _run(spark, sf, "document").next_state.select("slug", "status", "miss_count")


@query("run_events", f"""WITH {B.CLASSIFIED_SQL}, {_HELD}
SELECT site || '/' || slug AS entity_ref, CASE class WHEN 'missing' THEN 'updated' ELSE class END
  AS operation FROM classified WHERE entity_type = 'document'
  AND class IN ('created', 'updated', 'missing') AND site NOT IN (SELECT owner FROM held)""")
def run_events(spark, sf):
    return _run(spark, sf, "document").events.select("entity_ref", "operation")


@query("publish_in_order", f"""WITH {B.BATCH_SQL}, units AS (SELECT source_id, max(status) AS unit_status
  FROM incoming WHERE entity_type = 'official' GROUP BY 1)
SELECT slug, unit_status FROM incoming i LEFT JOIN units u ON i.source_id = u.source_id
WHERE entity_type = 'program_offering'""")
def publish_in_order(spark, sf):
    def units(done):
        rows = B.incoming(spark, sf).filter("entity_type = 'official'")
        return rows.groupBy("source_id").agg(F.max("status").alias("unit_status"))

    def offerings(done):
        rows = B.incoming(spark, sf).filter("entity_type = 'program_offering'")
        return rows.join(done["academic_unit"], "source_id", "left")

    done = ingest.publish_all({"program_offering": offerings, "academic_unit": units})
    return done["program_offering"].select("slug", "unit_status")


_REPORT_LEVEL = "CASE WHEN class IN ('missing', 'untouched') THEN 'high' ELSE " + _LEVEL + " END"


@query("batch_report", f"""WITH {B.CLASSIFIED_SQL}, rows AS (
  SELECT entity_type, slug, class, unnest(CASE WHEN class = 'updated' THEN list_filter([
      CASE WHEN old_band <> new_band THEN {{'field': 'band', 'f': CAST(old_band AS VARCHAR),
        't': CAST(new_band AS VARCHAR)}} END,
      CASE WHEN old_status <> new_status THEN {{'field': 'status', 'f': old_status,
        't': new_status}} END], lambda x: x IS NOT NULL) ELSE [NULL] END) AS d,
    {_REPORT_LEVEL} AS confidence FROM classified)
SELECT entity_type, slug, class, d.field AS field, d.f AS old_value, d.t AS new_value, confidence
FROM rows""")
def batch_report(spark, sf):
    """The flagship: what this batch changes, field by field, with the resulting confidence."""
    rows = classified(spark, sf)
    level = C.confidence(F.lit("crawl"), _entity_type(), F.lit(0))
    seen = F.col("class").isin("created", "updated", "unchanged")
    return rows.select(
        _entity_type().alias("entity_type"), "slug", "class",
        F.when(seen, level).otherwise(F.col("c.confidence")).alias("confidence"),
        F.explode_outer("diff").alias("field", "change")).select(
        "entity_type", "slug", "class", "field", F.col("change.from").alias("old_value"),
        F.col("change.to").alias("new_value"), "confidence")


@query("batch_freshness", f"""WITH {B.CLASSIFIED_SQL}, s AS (SELECT entity_type,
  {_REPORT_LEVEL} AS confidence, CASE WHEN class IN ('missing', 'untouched') THEN old_seen_at
    ELSE TIMESTAMP '{B.NOW_TEXT}' END AS verified FROM classified)
SELECT entity_type, {B.sql_day("min(verified)")} AS oldest_verified_at,
  CAST(max(datediff('day', verified, TIMESTAMP '{B.NOW_TEXT}')) AS INTEGER) AS max_staleness_days,
  CASE min(CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)
    WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS min_confidence,
  count(*) FILTER (confidence = 'high') AS n_high,
  count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low
FROM s GROUP BY 1""")
def batch_freshness(spark, sf):
    level = C.confidence(F.lit("crawl"), _entity_type(), F.lit(0))
    state = R.publish(classified(spark, sf), B.published(spark, sf), level, B.now())
    kind = F.regexp_extract("slug", "-(.*)$", 1)
    days = C.staleness_days(F.col("last_verified_at"), B.now())
    return H.freshness(state.select(kind.alias("entity_type"), "confidence", "last_verified_at",
                                    days.alias("staleness_days")), "entity_type").withColumn(
        "oldest_verified_at", B.day("oldest_verified_at"))
