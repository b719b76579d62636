"""Confidence recompute, freshness, coverage and health reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import confidence as C


def rescored(entities: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Entities with `new_confidence` from all inputs, editions and reachability included.

    `entities`: entity_type, entity_ref, source_id, confidence, last_verified_at, optionally
    effective_date and is_superseded. `sources`: source_id, method, source_status, optionally
    unreachable_since. An entity whose source is not known keeps its confidence.
    """
    facts = sources.select("source_id", "method", "source_status", F.lit(True).alias("_known"), *[
        c for c in ("unreachable_since",) if c in sources.columns])
    joined = entities.join(facts, "source_id", "left")
    days = C.staleness_days(F.col("last_verified_at"), now)
    since = (C.staleness_days(F.col("unreachable_since"), now)
             if "unreachable_since" in joined.columns else None)
    new = C.confidence(
        F.col("method"), F.col("entity_type"), days, now=now,
        effective_date=F.col("effective_date") if "effective_date" in joined.columns else None,
        superseded=F.col("is_superseded") if "is_superseded" in joined.columns else None,
        source_status=F.col("source_status"), unreachable_days=since)
    return joined.withColumn("new_confidence", F.when(F.col("_known"), new).otherwise(
        F.col("confidence"))).drop("_known")


def decay(entities: DataFrame, sources: DataFrame, now: Column
          ) -> tuple[DataFrame, DataFrame]:
    """(table, events): new confidence everywhere, one event per change.

    A recompute, so a second run gives no events. Both results read one join of the narrow
    columns; nothing is cached.
    """
    scored = rescored(entities, sources, now)
    table = scored.withColumn("confidence", F.col("new_confidence")).select(*entities.columns)
    changed = scored.filter(~F.col("new_confidence").eqNullSafe(F.col("confidence")))
    diff = F.create_map(F.lit("confidence"), F.struct(
        F.col("confidence").alias("from"), F.col("new_confidence").alias("to")))
    events = changed.select("entity_type", "entity_ref", F.lit("updated").alias("operation"),
                            diff.alias("diff"), now.alias("occurred_at"))
    return table, events


def min_confidence(df: DataFrame, level: str | None, column: str = "confidence") -> DataFrame:
    return df if level is None else df.filter(C.at_least(F.col(column), level))


def freshness_columns(days: str = "staleness_days", level: str = "confidence",
                      verified: str = "last_verified_at") -> list[Column]:
    """Freshness of whatever is aggregated; an empty set gives null, 0, null and zeros."""
    counted = [F.count_if(F.col(level) == name).alias(f"n_{name}")
               for name in reversed(K.CONFIDENCE_LEVELS)]
    return [F.min(verified).alias("oldest_verified_at"),
            F.coalesce(F.max(days), F.lit(0)).alias("max_staleness_days"),
            C.conf_name(F.min(C.conf_rank(F.col(level)))).alias("min_confidence"), *counted]


def freshness(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(*freshness_columns()) if by else df.agg(*freshness_columns())


def freshness_report(entities: DataFrame, site: str = "site") -> DataFrame:
    """Median and p95 staleness, counts and pct_high: overall, by site, by entity type.

    One pass over three grouping sets. The percentiles are exact, yet a group's buffer is a
    histogram of whole days, so it stays small however many rows a group has.
    """
    counted = ~F.col("entity_type").isin(*K.PCT_HIGH_EXCLUDED)
    high = F.col("confidence") == "high"
    return (entities.groupingSets([[], [F.col(site)], [F.col("entity_type")]],
                                  F.col(site), F.col("entity_type"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.percentile("staleness_days", 0.5).alias("median_staleness_days"),
                 F.percentile("staleness_days", 0.95).alias("p95_staleness_days"),
                 *[F.count_if(F.col("confidence") == n).alias(f"n_{n}")
                   for n in reversed(K.CONFIDENCE_LEVELS)],
                 F.count_if(high & counted).alias("_high"),
                 F.count_if(counted).alias("_counted"),
                 F.grouping_id().alias("_set"))
            .withColumn("scope", F.when(F.col("_set") == 3, "overall")
                        .when(F.col("_set") == 1, "site").otherwise("entity_type"))
            .withColumn("pct_high", F.when(F.col("_counted") > 0,
                                           F.col("_high") / F.col("_counted")).otherwise(0.0))
            .drop("_high", "_counted", "_set"))


def stalest(entities: DataFrame, site: str = "site") -> DataFrame:
    """Stalest row per site; ties go to the least (entity_type, entity_ref)."""
    top = entities.groupBy(site).agg(F.min(F.struct(
        (-F.col("staleness_days")).alias("neg"), "entity_type", "entity_ref", "source_url"))
        .alias("_top"))
    return top.select(site, "_top.entity_type", "_top.entity_ref",
                      (-F.col("_top.neg")).alias("staleness_days"), "_top.source_url")


def coverage(tables: Mapping[str, DataFrame], sites: DataFrame, site: str = "site") -> DataFrame:
    """Rows per site and entity type across all type tables; zero is reported.

    Each table is counted before the union, so only (site, type, count) rows meet. The grid of
    sites and types is an explode of the fixed type list.
    """
    counts = None
    for entity_type, table in tables.items():
        part = table.filter(F.col(site).isNotNull()).groupBy(site).agg(
            F.count(F.lit(1)).alias("rows")).withColumn("entity_type", F.lit(entity_type))
        counts = part if counts is None else counts.unionByName(part)
    grid = sites.select(site, F.explode(F.lit(list(tables))).alias("entity_type"))
    return grid.join(counts, [site, "entity_type"], "left").fillna(0, ["rows"])


def coverage_wide(counted: DataFrame, types: Sequence[str], site: str = "site") -> DataFrame:
    return counted.groupBy(site).pivot("entity_type", list(types)).agg(F.sum("rows"))


def source_status(sources: DataFrame, site: str = "site") -> DataFrame:
    status = F.col("source_status")
    return sources.filter(F.col(site).isNotNull()).groupBy(site).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "blocked").alias("blocked"),
        F.count_if(status.isin("unavailable", "suspended", "retired")).alias("unavailable"))


def last_ok_run(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("status") == "ok").groupBy("adapter").agg(
        F.max("finished_at").alias("last_ingest_at"))


def ingest_health(runs: DataFrame, now: Column) -> DataFrame:
    """Hours since the last success, one decimal; degraded when there is none or it is old."""
    last = runs.agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias(
        "last_successful_ingest_at"))
    hours = F.timestamp_diff("SECOND", F.col("last_successful_ingest_at"), now) / 3600
    stale = hours.isNull() | (hours > K.STALE_AFTER_HOURS)
    return last.select("last_successful_ingest_at",
                       F.round(hours, 1).alias("hours_since_ingest"),
                       F.when(stale, "degraded").otherwise("ok").alias("health"))


def check_freshness(refs: DataFrame, entities: DataFrame, sources: DataFrame, now: Column
                    ) -> DataFrame:
    """Staleness, confidence and source facts for a list of refs; unknown refs stay, empty."""
    facts = sources.select("source_id", "source_url", "source_status")
    found = refs.join(entities.select("entity_ref", "source_id", "confidence",
                                      "last_verified_at"), "entity_ref", "left")
    return found.join(facts, "source_id", "left").select(
        "entity_ref", F.when(F.col("last_verified_at").isNotNull(), C.staleness_days(
            F.col("last_verified_at"), now)).alias("staleness_days"),
        "confidence", "source_url", "source_status", "last_verified_at")


def with_assertion_policy(df: DataFrame) -> DataFrame:
    return df.withColumn("consumer_action", C.assertion_policy(
        F.col("entity_type"), F.col("confidence"), F.col("staleness_days")))


def with_provenance(df: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """The provenance struct every published row carries."""
    facts = sources.select("source_id", "source_url", "method")
    return df.join(facts, "source_id").withColumn("provenance", F.struct(
        "source_url", "method", "first_seen_at", "last_verified_at",
        C.staleness_days(F.col("last_verified_at"), now).alias("staleness_days"), "confidence"))
