"""Validation: reject, never coerce."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K

SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


@dataclass(frozen=True)
class Rule:
    """`ok` must hold for a non-null value; `nullable` says whether null passes."""
    field: str
    ok: Callable[[Column], Column]
    message: str
    nullable: bool = False

    def broken(self) -> Column:
        value = F.col(self.field)
        failed = ~F.coalesce(self.ok(value), F.lit(False))
        return failed & value.isNotNull() if self.nullable else failed


def slug(field: str, nullable: bool = False) -> Rule:
    return Rule(field, lambda c: F.regexp(c, F.lit(SLUG)),
                "must be lowercase alphanumeric with single hyphens", nullable)


def non_empty(field: str, nullable: bool = False) -> Rule:
    return Rule(field, lambda c: F.length(F.trim(c)) > 0, "must not be empty", nullable)


def one_of(field: str, domain: Sequence[str], nullable: bool = False) -> Rule:
    return Rule(field, lambda c: c.isin(*domain), "not in the allowed set", nullable)


def in_range(field: str, above: float, upto: float, nullable: bool = False) -> Rule:
    return Rule(field, lambda c: (c > above) & (c <= upto), f"outside ({above}, {upto}]", nullable)


def all_non_empty(field: str) -> Rule:
    return Rule(field, lambda c: F.forall(c, lambda x: F.coalesce(
        F.length(F.trim(x)) > 0, F.lit(False))), "has an empty item", True)


UNIT_RULES = [
    slug("slug"), non_empty("name"), non_empty("abbreviation", True),
    one_of("unit_type", K.UNIT_TYPES), non_empty("description", True),
    non_empty("head_name", True), non_empty("head_title", True),
    one_of("status", K.UNIT_STATUSES),
]
OFFERING_RULES = [
    non_empty("source_name"), slug("slug"), non_empty("local_name", True),
    slug("unit_slug", True), all_non_empty("majors"), in_range("years", 0, 12, True),
    one_of("status", K.OFFERING_STATUSES),
]
# Domain checks of curated rows, which have rules but are not emitted by parsers.
PROGRAM_RULES = [
    slug("slug"), non_empty("name"), one_of("level", K.DEGREE_LEVELS),
    in_range("typical_years", 0, 12, True),
]
SOURCE_RULES = [
    non_empty("url"), one_of("method", K.INGEST_METHODS), one_of("status", K.SOURCE_STATUSES),
]
RECORD_RULES = {"academic_unit": UNIT_RULES, "program_offering": OFFERING_RULES}


def first_violation(rules: Mapping[str, Sequence[Rule]]) -> Column:
    """First broken rule of the row's entity type as struct(field, message), else null."""
    checks = [
        F.when((F.col("entity_type") == entity_type) & rule.broken(),
               F.struct(F.lit(rule.field).alias("field"), F.lit(rule.message).alias("message")))
        for entity_type, of_type in rules.items() for rule in of_type]
    return F.coalesce(*checks)


def validate(records: DataFrame, rules: Mapping[str, Sequence[Rule]]
             ) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects). Types without rules are in neither; see `unmodelled_types`.

    Both are narrow filters over the same scan, so nothing is cached or shuffled.
    """
    checked = records.filter(F.col("entity_type").isin(*rules)).withColumn(
        "_violation", first_violation(rules))
    valid = checked.filter(F.col("_violation").isNull()).drop("_violation")
    rejects = checked.filter(F.col("_violation").isNotNull()).select(
        "*", F.col("_violation.field").alias("field"),
        F.col("_violation.message").alias("message")).drop("_violation")
    return valid, rejects


def reject_unknown_fields(df: DataFrame, json_col: str, allowed: Sequence[str]) -> DataFrame:
    """Strict shape: `unknown_fields` of each JSON record; non-empty means rejected."""
    keys = F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))
    return df.withColumn("unknown_fields", F.array_except(keys, F.lit(list(allowed))))


def fill_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults.items()})


def unmodelled_types(records: DataFrame, rules: Mapping[str, Sequence[Rule]],
                     source: str = "source_id") -> DataFrame:
    """One warning per source and entity type that nothing validates, so nothing publishes."""
    return records.filter(~F.col("entity_type").isin(*rules)).groupBy(
        source, "entity_type").agg(F.count(F.lit(1)).alias("records")).withColumn(
        "warning", F.concat(F.lit("no record rules for entity type "), F.col("entity_type")))


def parsed_counts(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("parsed"))


def personal_contacts(df: DataFrame, domains: Sequence[str], email: str = "email") -> DataFrame:
    """Rows whose e-mail address is on a consumer mail domain."""
    return df.filter(F.lower(F.split_part(F.col(email), F.lit("@"), F.lit(-1))).isin(*domains))
