"""A whole run as frames: merge, guard, rename, reconcile, next state, events.

The guard comes before anything is derived from the batch, so a quarantined (owner, type)
changes nothing. Frames are lazy: a dry run aggregates them, a real run writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.confidence import confidence
from attesta.operators import lifecycle as L
from attesta.operators import reconcile as R
from attesta.operators.match import merge_by_key
from attesta.session import materialize
from attesta.sources import store


@dataclass
class RunPlan:
    run_id: str
    verdicts: DataFrame
    classified: DataFrame
    next_state: DataFrame
    events: DataFrame
    quarantine: DataFrame
    quarantine_payload: DataFrame
    aliases: DataFrame | None = None

    def counts(self) -> DataFrame:
        """What a dry run reports."""
        return R.class_counts(self.classified)


def plan(incoming: DataFrame, table: DataFrame, parsed_sources: DataFrame,
         expectations: DataFrame, *, entity_type: str, run_id: str, now: Column,
         fields: Sequence[str], keys: Sequence[str] = ("site", "slug"),
         mode: str = "incremental", order: Sequence[str] = ("pos",),
         arrays: Sequence[str] = (), name: str | None = None, settle: bool = False,
         partial: bool = False) -> RunPlan:
    """Plan one entity type of a run over any number of owners at once.

    `incoming`: validated records with owner, keys, fields, source_id, status and `order`.
    `table`: published rows with owner and the provenance columns. With `name`, rows are
    followed across keys by that durable name.

    The plan is lazy. With `settle`, the frames that several outputs share (merged batch,
    verdicts, moves, classified rows) are written once to the shared folder: state, events and
    logs are then narrow scans, and the guard and the full-outer join run once per run.

    A `partial` batch is a piece of a run, such as a micro-batch. What it lacks may come with the
    next piece, so its counts say nothing: no owner is held back and no row ages.
    """
    if partial and name is not None:
        raise ValueError("renames need a whole run")
    keys = list(keys)

    def shared(df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label) if settle else df

    merged = shared(merge_by_key(incoming, keys, order, arrays).drop("merged_rows"), "merged")
    in_scope = R.scope(table, parsed_sources)
    typed = F.lit(entity_type)
    counts = R.guard_inputs(merged.withColumn("entity_type", typed),
                            incoming.select("owner", typed.alias("entity_type")),
                            in_scope.withColumn("entity_type", typed), expectations)
    judged = R.guard(counts, mode)
    if partial:
        judged = judged.withColumns({"reason": F.lit(None).cast("string"),
                                     "action": F.lit("publish")})
    verdicts = shared(judged, "verdicts")
    held = verdicts.filter(F.col("action") == "quarantine").select("owner").distinct()
    passed = merged.join(held, "owner", "left_anti")
    batches, payload = R.quarantine_rows(verdicts, merged.withColumn("entity_type", typed),
                                         run_id)
    current, aliases, move_events = table, None, None
    # Quarantined owners count as not examined.
    held_sources = table.join(held, "owner", "left_semi").select("source_id")
    examined = parsed_sources.join(held_sources, "source_id", "left_anti")
    if name is not None:
        live = R.scope(table, examined)
        moves = shared(L.renames(incoming.join(held, "owner", "left_anti"), live, keys[-1], name,
                                 order), "moves")
        aliases, move_events = L.aliases_of(moves), L.move_events(moves, run_id, now)
        current = L.apply_renames(table, moves, keys[-1])
    sorted_out = R.reconcile(passed, current, keys, fields, examined)
    if partial:
        sorted_out = sorted_out.replace("missing", "untouched", "class")
    classified = shared(sorted_out, "classified")
    level = confidence(F.lit("crawl"), typed, F.lit(0))
    next_state = R.publish(classified, current, level, now)
    events = R.change_events(classified, F.concat_ws("/", *keys), typed, run_id, now)
    if name is not None:
        next_state = next_state.unionByName(L.retire_superseded(table, moves, keys[-1]))
        events = events.unionByName(move_events.withColumn("entity_type", typed))
    return RunPlan(run_id, verdicts, classified, next_state, events, batches, payload, aliases)


def touched_by(run: RunPlan, path: str, keys: Sequence[str]) -> list[int] | None:
    """Buckets of the table in which the run changes a row; None, all of them, where rows move
    from key to key."""
    if run.aliases is not None:
        return None
    changed = run.classified.filter(F.col("class") != "untouched")
    return store.touched_buckets(changed, path, keys)


def commit(run: RunPlan, root: str, table: str, cluster_by: Sequence[str] = (),
           version: int | None = None, keys: Sequence[str] = (),
           only: Sequence[int] | None = None) -> int:
    """Write a run: logs first, the table last, so a state never precedes its events.

    A run that failed half-way and is repeated replaces its own logs. With the table's `keys` it is
    kept in buckets, and only those with a changed row are written: those of `only`, where the run
    was planned over a part of the table, else those that the classified rows name.
    """
    path = f"{root}/{table}"
    if keys and only is None and store.current_version(run.classified.sparkSession, path, version):
        only = touched_by(run, path, keys)
    store.write_log(run.quarantine, f"{root}/quarantine", run.run_id)
    store.write_log(run.quarantine_payload, f"{root}/quarantine_payload", run.run_id)
    store.write_log(run.events, f"{root}/change_events", run.run_id)
    if run.aliases is not None:
        store.write_log(run.aliases, f"{root}/slug_aliases", run.run_id)
    return store.write_version(run.next_state, path, cluster_by, version, keys, only)


def publish_all(steps: Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]]
                ) -> dict[str, DataFrame]:
    """Parents before children: each step sees the published frames of the types before it."""
    done: dict[str, DataFrame] = {}
    ordered = [t for t in K.PUBLISH_ORDER if t in steps] + [
        t for t in steps if t not in K.PUBLISH_ORDER]
    for entity_type in ordered:
        done[entity_type] = steps[entity_type](done)
    return done
