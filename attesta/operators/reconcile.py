"""Reconcile a batch with the published table: classes, diffs, guard, next state, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import constants as K

# Fixed value: the arrow in the guard's reasons.
ARROW = "→"


def scope(current: DataFrame, parsed_sources: DataFrame, source: str = "source_id") -> DataFrame:
    """Published rows whose source was parsed in this run; the others were not examined."""
    return current.join(parsed_sources.select(source), source, "left_semi")


def _comparable(col: Column, data_type: T.DataType) -> Column:
    """Maps have no equality; their sorted entries do."""
    if isinstance(data_type, T.MapType):
        return F.sort_array(F.map_entries(col))
    return col


def _as_text(col: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col)
    return col.cast("string")


def field_diff(fields: Sequence[str], schema: T.StructType, before: str, after: str) -> Column:
    """Map of changed fields to (from, to), null-safe, arrays by order and value."""
    entries = []
    for name in fields:
        kind = schema[name].dataType
        old, new = F.col(f"{before}.{name}"), F.col(f"{after}.{name}")
        same = _comparable(old, kind).eqNullSafe(_comparable(new, kind))
        entries.append(F.when(~same, F.struct(
            F.lit(name).alias("key"),
            F.struct(_as_text(old, kind).alias("from"), _as_text(new, kind).alias("to"))
            .alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def reconcile(incoming: DataFrame, current: DataFrame, keys: Sequence[str],
              fields: Sequence[str], parsed_sources: DataFrame | None = None) -> DataFrame:
    """Classify by key in one full-outer join: created, updated, unchanged, missing, untouched.

    Both sides are unique on `keys`. With `parsed_sources`, a published row of another source
    is `untouched` when the batch lacks its key and `created` (taken over) when it has it.
    Columns: keys, class, diff, `i` (incoming row), `c` (current row).
    """
    keys = list(keys)
    if parsed_sources is None:
        scoped = current.withColumn("_scoped", F.lit(True))
    else:
        seen = parsed_sources.select("source_id").distinct().withColumn("_scoped", F.lit(True))
        scoped = current.join(seen, "source_id", "left")
    left = incoming.select(*keys, F.struct(*incoming.columns).alias("i"))
    right = scoped.select(*keys, F.struct(*current.columns).alias("c"),
                          F.coalesce("_scoped", F.lit(False)).alias("_scoped"))
    joined = left.join(right, keys, "full_outer")
    gone, fresh = F.col("i").isNull(), F.col("c").isNull() | ~F.col("_scoped")
    diff = field_diff(fields, current.schema, "c", "i")
    both = F.when(~gone & ~fresh, diff)
    return joined.withColumn("diff", both).withColumn(
        "class", F.when(gone & F.col("_scoped"), "missing").when(gone, "untouched")
        .when(fresh, "created").when(F.size("diff") > 0, "updated").otherwise("unchanged")
    ).select(*keys, "class", "diff", "i", "c")


def class_counts(classified: DataFrame, *by: str) -> DataFrame:
    def counted(name: str) -> Column:
        return F.count_if(F.col("class") == name).alias(name)
    return classified.groupBy(*by).agg(
        *[counted(n) for n in ("created", "updated", "unchanged", "missing", "untouched")])


def guard_inputs(incoming: DataFrame, emitted: DataFrame, current: DataFrame,
                 expectations: DataFrame) -> DataFrame:
    """Counts per (owner, entity_type) for every type emitted or expected.

    A type counts as emitted even if all its records were rejected, so an emptied page still
    reaches the guard. `expectations`: (owner, entity_type, min_rows, max_rows).
    """
    by = ["owner", "entity_type"]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))

    ran = emitted.select("owner").distinct()
    wanted = expectations.join(ran, "owner", "left_semi")
    types = emitted.select(*by).union(wanted.select(*by)).distinct()
    return (types.join(counted(incoming, "incoming_count"), by, "left")
            .join(counted(current, "current_count"), by, "left")
            .join(expectations, by, "left")
            .fillna(0, ["incoming_count", "current_count"]))


def guard(counts: DataFrame, mode: str = "incremental") -> DataFrame:
    """Publish or quarantine each (owner, entity_type), with the reason in words.

    Expected ranges are full-run ranges; an incremental run notes that they were skipped.
    """
    n, cur = F.col("incoming_count"), F.col("current_count")
    kind, low, high = F.col("entity_type"), F.col("min_rows"), F.col("max_rows")
    ranged = low.isNotNull()
    outside = ranged & ((n < low) | (n > high)) if mode == "full" else F.lit(False)
    zero = (cur > 0) & (n == 0)
    dropped = (cur >= K.GUARD_FLOOR) & (n < cur * F.lit(K.GUARD_DROP).cast("decimal(3,1)"))
    doubled = (cur >= K.GUARD_FLOOR) & (n > cur * K.GUARD_DOUBLE)
    reason = (
        F.when(outside, F.format_string("count %d outside expected [%d,%d] for %s",
                                        n, low, high, kind))
        .when(zero, F.format_string("parser returned zero %s records where %d existed",
                                    kind, cur))
        .when(dropped, F.format_string(f"%s count dropped %d{ARROW}%d (>30%%)", kind, cur, n))
        .when(doubled, F.format_string(f"%s count doubled %d{ARROW}%d", kind, cur, n)))
    skipped = (F.when(ranged, F.format_string(
        "expectations [%d,%d] not applied: incremental run", low, high))
        if mode != "full" else F.lit(None).cast("string"))
    return (counts.withColumn("reason", reason).withColumn("skipped", skipped)
            .withColumn("action", F.when(F.col("reason").isNull(), "publish").otherwise(
                "quarantine")))


def quarantine_rows(verdicts: DataFrame, incoming: DataFrame, run_id: str
                    ) -> tuple[DataFrame, DataFrame]:
    """(batches, payload): one header per rejected batch, one JSON row per rejected record.

    The payload stays one row per record: a batch may be a third of all rows, and gathering it
    into one JSON document would put it into one task.
    """
    by = ["owner", "entity_type"]
    rejected = verdicts.filter(F.col("action") == "quarantine")
    batches = rejected.select(F.lit(run_id).alias("run_id"), *by, "reason", "incoming_count",
                              "current_count")
    record = F.to_json(F.struct(*[c for c in incoming.columns if c not in by]))
    payload = incoming.join(rejected.select(*by), by, "left_semi").select(
        F.lit(run_id).alias("run_id"), *by, record.alias("payload"))
    return batches, payload


def status_for_misses(misses: Column) -> Column:
    """One or two misses: unknown. Three: removed. Whatever the status was before."""
    return (F.when(misses >= K.MISSES_TO_REMOVE, "removed").when(misses >= 1, "unknown")
            .otherwise("active"))


def age_missing(missing: DataFrame) -> DataFrame:
    """Add one miss and the status that follows; `changed` marks rows that need an event."""
    aged = missing.withColumn("old_status", F.col("status")).withColumn(
        "miss_count", F.col("miss_count") + 1)
    return aged.withColumn("status", status_for_misses(F.col("miss_count"))).withColumn(
        "changed", ~F.col("status").eqNullSafe(F.col("old_status")))


def publish(classified: DataFrame, table: DataFrame, confidence: Column, now: Column
            ) -> DataFrame:
    """The next table state, one projection over the classified rows: no further shuffle.

    created inserts or takes over, updated overwrites, unchanged refreshes, missing ages,
    untouched stays.
    """
    incoming_fields = {f.name for f in classified.schema["i"].dataType.fields}
    kind = F.col("class")
    written, seen = kind.isin("created", "updated"), kind.isin("created", "updated", "unchanged")
    misses = F.col("c.miss_count") + 1
    out = []
    for name in table.columns:
        old = F.col(f"c.{name}")
        if name == "first_seen_at":
            value = F.coalesce(old, now)
        elif name == "last_verified_at":
            value = F.when(seen, now).otherwise(old)
        elif name == "miss_count":
            value = F.when(seen, F.lit(0)).when(kind == "missing", misses).otherwise(old)
        elif name == "confidence":
            value = F.when(seen, confidence).otherwise(old)
        elif name == "status":
            value = (F.when(written, F.col("i.status")).when(
                kind == "missing", status_for_misses(misses)).otherwise(old))
        elif name in incoming_fields:
            value = F.when(written, F.col(f"i.{name}")).otherwise(old)
        else:
            value = old
        out.append(value.cast(table.schema[name].dataType).alias(name))
    return classified.select(*out)


def change_events(classified: DataFrame, ref: Column, entity_type: Column, run_id: str,
                  now: Column) -> DataFrame:
    """One event per created, updated or status-changing missing row."""
    kind = F.col("class")
    next_status = status_for_misses(F.col("c.miss_count") + 1)
    turned = (kind == "missing") & ~next_status.eqNullSafe(F.col("c.status"))
    status_diff = F.create_map(F.lit("status"), F.struct(
        F.col("c.status").alias("from"), next_status.alias("to")))
    return classified.filter(kind.isin("created", "updated") | turned).select(
        F.lit(run_id).alias("run_id"), now.alias("occurred_at"),
        entity_type.alias("entity_type"), ref.alias("entity_ref"),
        F.when(kind != "missing", kind).when(next_status == "removed", "removed")
        .otherwise("updated").alias("operation"),
        F.when(kind == "updated", F.col("diff")).when(kind == "missing", status_diff)
        .alias("diff"))


def with_key(df: DataFrame, site: str = "site", source_key: str = "source_key",
             slug: str = "slug") -> DataFrame:
    """Identity where a site gives its own key, else by slug, tagged so the two never meet."""
    has = F.col(source_key).isNotNull()
    return df.withColumn("identity", F.when(
        has, F.concat_ws("/", F.lit("key"), F.col(site), F.col(source_key))).otherwise(
        F.concat_ws("/", F.lit("slug"), F.col(site), F.col(slug))))
