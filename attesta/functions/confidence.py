"""Confidence and staleness as column expressions over fixed policy maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import constants as K


def policy(mapping: dict, key: Column) -> Column:
    """Look up a fixed policy table held as a map literal: no join, no shuffle."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, key)


def _ranks(mapping: dict[str, str]) -> dict[str, int]:
    return {key: K.CONFIDENCE_LEVELS.index(level) for key, level in mapping.items()}


def staleness_days(verified_at: Column, now: Column) -> Column:
    """Whole days since verification, floored, never negative."""
    seconds = F.timestamp_diff("SECOND", verified_at, now)
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")


def conf_rank(col: Column) -> Column:
    """0 low, 1 medium, 2 high: the strings themselves must never be compared."""
    return F.array_position(F.lit(K.CONFIDENCE_LEVELS), col).cast("int") - 1


def conf_name(rank: Column) -> Column:
    return F.get(F.lit(K.CONFIDENCE_LEVELS), rank)


def lower_of(a: Column, b: Column) -> Column:
    return conf_name(F.least(conf_rank(a), conf_rank(b)))


def confidence(method: Column, entity_type: Column, days: Column, *, now: Column | None = None,
               effective_date: Column | None = None, superseded: Column | None = None,
               source_status: Column | None = None,
               unreachable_days: Column | None = None) -> Column:
    """A recompute from its inputs, so running it twice changes nothing."""
    low, medium = F.lit(0), F.lit(1)
    base = policy(_ranks(K.BASE_BY_METHOD), method)
    cap = F.coalesce(policy(_ranks(K.CAP_BY_ENTITY), entity_type), F.lit(2))
    level = F.least(base, cap)
    level = (F.when(days >= policy(K.DECAY_TO_LOW, entity_type), low)
             .when(days >= policy(K.DECAY_TO_MEDIUM, entity_type), F.least(level, medium))
             .otherwise(level))
    if source_status is not None:
        gone = F.coalesce(source_status.isin("unavailable", "blocked"), F.lit(False))
        since = F.coalesce(unreachable_days, F.lit(0)) if unreachable_days is not None else F.lit(0)
        level = (F.when(gone & (since >= K.UNREACHABLE_LOW_DAYS), low)
                 .when(gone, F.least(level, medium)).otherwise(level))
    is_document = entity_type == "document"
    if superseded is not None:
        level = F.when(is_document & F.coalesce(superseded, F.lit(False)), low).otherwise(level)
    if effective_date is not None:
        age = F.timestamp_diff("SECOND", effective_date, now)
        old = F.coalesce(age > K.OLD_EDITION_DAYS * 86400, F.lit(False))
        level = F.when(is_document & old, low).otherwise(level)
    return conf_name(level)


def at_least(confidence_col: Column, level: str) -> Column:
    """Inclusive confidence floor."""
    return conf_rank(confidence_col) >= K.CONFIDENCE_LEVELS.index(level)


def assertion_policy(entity_type: Column, confidence_col: Column, days: Column) -> Column:
    """What a consumer owes the reader: refuse, caveat, show the date, or nothing."""
    sensitive = entity_type.isin("fee_estimate", "scholarship", "announcement")
    weak = (confidence_col == "low") | (days > 180)
    return (F.when(sensitive & weak, "refuse").when(weak, "caveat")
            .when(sensitive, "show_date").otherwise("plain"))
