"""Renames, aliases, takedown, retention and replay of the change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.operators.admission import match_excluded
from attesta.session import materialize


def renames(incoming: DataFrame, current: DataFrame, key: str = "slug", name: str = "source_name",
            order: Sequence[str] = ("pos",)) -> DataFrame:
    """Rows that moved to another key under the same durable name.

    Columns: old_key, new_key, action. `rename` when the new key is free: the row moves.
    `supersede` when the new key is taken, by a current row or by an earlier rename: the old
    row is retired and forwards to it. Both leave an alias.

    `incoming` is taken before merging by key, so several names may lead to one key. A name
    carried by many current rows counts through the greatest key only, and a current row that
    is itself sighted again never moves.
    """
    priors = current.groupBy(name).agg(F.max(key).alias("old_key"))
    sighted = incoming.select(F.col(key).alias("old_key")).distinct()
    movable = priors.join(sighted, "old_key", "left_anti")
    claims = incoming.groupBy(name, key).agg(F.min(F.struct(*order)).alias("_pos"))
    moved = claims.join(movable, name).groupBy("old_key").agg(
        F.min(F.struct("_pos", F.col(key).alias("new_key"))).alias("_to")).select(
        "old_key", "_to.new_key", "_to._pos")
    taken = current.select(F.col(key).alias("new_key")).distinct().withColumn(
        "_taken", F.lit(True))
    first = moved.groupBy("new_key").agg(F.min(F.struct("_pos", "old_key")).alias("_first"))
    return (moved.join(first, "new_key").join(taken, "new_key", "left")
            .withColumn("action", F.when(
                F.col("_taken").isNull() & (F.col("old_key") == F.col("_first.old_key")),
                "rename").otherwise("supersede"))
            .select("old_key", "new_key", "action"))


def apply_renames(current: DataFrame, moves: DataFrame, key: str = "slug") -> DataFrame:
    """Current rows under their new keys; superseded rows leave the live set."""
    joined = current.join(moves.withColumnRenamed("old_key", key), key, "left")
    return joined.filter(F.coalesce(F.col("action") != "supersede", F.lit(True))).withColumn(
        key, F.coalesce("new_key", key)).select(*current.columns)


def retire_superseded(current: DataFrame, moves: DataFrame, key: str = "slug") -> DataFrame:
    gone = moves.filter(F.col("action") == "supersede").select(F.col("old_key").alias(key))
    return current.join(gone, key, "left_semi").withColumn("status", F.lit("removed"))


def aliases_of(moves: DataFrame) -> DataFrame:
    return moves.select(F.col("old_key").alias("old_ref"), F.col("new_key").alias("new_ref"))


def upsert_aliases(aliases: DataFrame, fresh: DataFrame) -> DataFrame:
    """Last write wins per old ref."""
    kept = aliases.join(fresh.select("old_ref"), "old_ref", "left_anti")
    return kept.select("old_ref", "new_ref").unionByName(fresh.select("old_ref", "new_ref"))


def move_events(moves: DataFrame, run_id: str, now: Column) -> DataFrame:
    renamed = F.col("action") == "rename"
    change = F.when(renamed, F.struct(F.col("old_key").alias("from"), F.col("new_key").alias("to"))
                    ).otherwise(F.struct(F.lit(None).cast("string").alias("from"),
                                         F.col("new_key").alias("to")))
    return moves.select(
        F.lit(run_id).alias("run_id"), now.alias("occurred_at"),
        F.when(renamed, F.col("new_key")).otherwise(F.col("old_key")).alias("entity_ref"),
        F.when(renamed, "updated").otherwise("removed").alias("operation"),
        F.create_map(F.when(renamed, "ref").otherwise("superseded_by"), change).alias("diff"))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Final ref of every alias: (old_ref, final_ref, hops); a cycle has a null final_ref.

    Pointer doubling: each round joins the edge table with itself and doubles the distance
    covered, so the longest chain of n edges takes log2(n) rounds. As long as a chain is
    unfinished, some edge of it finishes in the next round; a round that finishes none leaves
    only cycles and what leads into them. Each round is written to the shared folder, which
    keeps the plan short and survives lost executors.
    """
    edges = materialize(aliases.select("old_ref", F.col("new_ref").alias("to"),
                                       F.lit(1).cast("long").alias("hops")), "aliases")
    unfinished = None
    while True:
        step = edges.select(F.col("old_ref").alias("to"), F.col("to").alias("_next"),
                            F.col("hops").alias("_more"))
        joined = edges.drop("_open").join(step, "to", "left")
        edges = materialize(joined.select(
            "old_ref", F.coalesce("_next", "to").alias("to"),
            (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"),
            F.col("_next").isNotNull().alias("_open")), "aliases")
        before, unfinished = unfinished, edges.filter("_open").count()
        if unfinished in (0, before):
            break
    cyclic = F.col("_open")
    return edges.select("old_ref", F.when(~cyclic, F.col("to")).alias("final_ref"),
                        F.when(~cyclic, F.col("hops")).alias("hops"))


def unit_tree(units: DataFrame, ref: str = "ref", parent: str = "parent_ref") -> DataFrame:
    """Root, depth and number of children of every unit, by pointer doubling."""
    edges = units.filter(F.col(parent).isNotNull()).select(
        F.col(ref).alias("old_ref"), F.col(parent).alias("new_ref"))
    up = resolve_aliases(edges).select(F.col("old_ref").alias(ref),
                                       F.col("final_ref").alias("root"),
                                       F.col("hops").alias("depth"))
    children = edges.groupBy(F.col("new_ref").alias(ref)).agg(
        F.count(F.lit(1)).alias("children"))
    # A root has depth 0; a unit behind a cycle keeps a null root.
    is_root = F.col(parent).isNull()
    return (units.select(ref, parent).join(up, ref, "left").join(children, ref, "left")
            .withColumn("root", F.when(is_root, F.col(ref)).otherwise(F.col("root")))
            .withColumn("depth", F.when(is_root, F.lit(0)).otherwise(F.col("depth")))
            .withColumn("children", F.coalesce("children", F.lit(0))))


def purge(entities: DataFrame, patterns: DataFrame, url: str = "source_url") -> DataFrame:
    """Takedown: rows whose source matches an exclusion leave; snapshots are not touched."""
    return match_excluded(entities, patterns, url).filter(
        F.col("excluded_by").isNull()).drop("excluded_by")


def retain(events: DataFrame, now: Column, months: int = K.RETENTION_MONTHS) -> DataFrame:
    return events.filter(F.col("occurred_at") >= _window_start(now, months))


def _window_start(now: Column, months: int) -> Column:
    return now - F.make_ym_interval(F.lit(0), F.lit(months))


def resume_status(since: Column, now: Column, months: int = K.RETENTION_MONTHS) -> Column:
    """`expired` asks for a full resync instead of a silently truncated feed."""
    return F.when(since < _window_start(now, months), "expired").otherwise("ok")


def state_as_of(events: DataFrame, at: Column) -> DataFrame:
    """(entity_ref, field, value): last value of every field by the change log at a time.

    A removed row has no fields. Values are folded by `max_by`, combined map-side, so a field
    that changed very often costs no more than one that changed once.
    """
    known = events.filter(F.col("occurred_at") <= at)
    place = F.struct("occurred_at", "id")
    fields = known.select("entity_ref", place.alias("_at"),
                          F.explode("diff").alias("field", "change"))
    last = fields.groupBy("entity_ref", "field").agg(
        F.max_by("change.to", "_at").alias("value"))
    gone = known.groupBy("entity_ref").agg(F.max_by("operation", place).alias("_op")).filter(
        F.col("_op") == "removed")
    return last.join(gone, "entity_ref", "left_anti")


