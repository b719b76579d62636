"""Catalogue queries: filtered listings, lookups, paging, nested payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as X
from attesta.operators.freshness import min_confidence
from attesta.operators.skew import number_rows


def listing(df: DataFrame, equals: Mapping[str, object] | None = None, q: str | None = None,
            q_column: str = "name", floor: str | None = None) -> DataFrame:
    """Filters that are absent never enter the plan; the others reach the scan."""
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if q:
        df = df.filter(X.contains_ci(F.col(q_column), q))
    return min_confidence(df, floor)


def list_sites(sites: DataFrame, kind: str | None = None, floor: str | None = None) -> DataFrame:
    return listing(sites, {"kind": kind}, floor=floor).orderBy("site")


def list_units(units: DataFrame, site: str | None = None, unit_type: str | None = None,
               floor: str | None = None) -> DataFrame:
    return listing(units, {"site": site, "unit_type": unit_type}, floor=floor).orderBy("ref")


def list_programs(programs: DataFrame, offerings: DataFrame, *, site: str | None = None,
                  unit: str | None = None, status: str | None = None, level: str | None = None,
                  discipline: str | None = None, q: str | None = None,
                  floor: str | None = None) -> DataFrame:
    """Site, unit and status describe an offering, so they narrow by existence: a semi join
    against the filtered offerings, never a join followed by a distinct."""
    rows = listing(programs, {"level": level, "discipline": discipline}, q, floor=floor)
    if site or unit or status:
        child = listing(offerings, {"site": site, "unit_ref": unit, "status": status})
        rows = rows.join(child.select("program_slug"),
                         F.col("slug") == F.col("program_slug"), "left_semi")
    return rows


def list_offerings(offerings: DataFrame, sources: DataFrame, programs: DataFrame,
                   units: DataFrame, *, site: str | None = None, status: str | None = None,
                   program: str | None = None, unmatched: bool | None = None,
                   q: str | None = None, floor: str | None = None) -> DataFrame:
    rows = listing(offerings, {"site": site, "status": status, "program_slug": program}, q,
                   "source_name", floor)
    if unmatched is not None:
        gap = F.col("program_slug").isNull()
        rows = rows.filter(gap if unmatched else ~gap)
    named = programs.select(F.col("slug").alias("program_slug"),
                            F.col("name").alias("program_name"))
    placed = units.select(F.col("ref").alias("unit_ref"), F.col("name").alias("unit_name"),
                          "unit_type")
    return (rows.join(sources.select("source_id", "source_url", "method"), "source_id")
            .join(named, "program_slug", "left").join(placed, "unit_ref", "left"))


def program_with_offerings(programs: DataFrame, offerings: DataFrame,
                           site: str | None = None) -> DataFrame:
    """Every program with its offerings nested in site order, empty array when it has none.

    (program, site) is unique among offerings, so a nested array is bounded by the sites.
    """
    child = listing(offerings, {"site": site}).groupBy("program_slug").agg(
        F.sort_array(F.collect_list(F.struct("site", "ref", "status", "source_name")))
        .alias("offerings"))
    empty = F.array().cast(child.schema["offerings"].dataType)
    return programs.join(child, F.col("slug") == F.col("program_slug"), "left").withColumn(
        "offerings", F.coalesce("offerings", empty)).drop("program_slug")


def lookup(refs: DataFrame, entity: DataFrame, ref: str = "ref"
           ) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) for many refs at once; the misses go on to suggestions."""
    hits = refs.select(ref).join(entity, ref)
    return hits, refs.select(ref).join(entity.select(ref), ref, "left_anti")


def keyset_page(df: DataFrame, key: str, after: object | None = None,
                limit: int = K.PAGE_SIZE) -> DataFrame:
    """The page after a key. `has_more` comes from one extra row, not from a full page.

    The key filter reaches the scan and the order plus limit run as one top-k.
    """
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    ahead = rows.orderBy(key).limit(limit + 1)
    page = ahead.agg(F.sort_array(F.collect_list(F.struct(
        F.col(key).alias("_key"), F.struct(*df.columns).alias("_row")))).alias("_rows"))
    size = F.size("_rows")
    return page.select(
        (size > limit).alias("has_more"),
        F.when(size > limit, F.get("_rows", F.lit(limit - 1))["_key"]).alias("next_key"),
        F.explode(F.slice("_rows", 1, limit)).alias("_item")
    ).select("_item._row.*", "has_more", "next_key")


def paginate_all(df: DataFrame, order: Sequence[str], size: int = K.PAGE_SIZE) -> DataFrame:
    """Every row with its page number, for bulk export; independent of who asks for pages."""
    return number_rows(df, order).withColumn("page", F.floor(F.col("row_no") / size))


def _given(df: DataFrame, *names: str) -> list[Column]:
    """Payload fields are always there: null where the frame does not carry them."""
    return [F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names]


def _strings(df: DataFrame, name: str) -> Column:
    empty = F.array().cast("array<string>")
    return (F.coalesce(name, empty) if name in df.columns else empty).alias(name)


def present_offering(df: DataFrame) -> DataFrame:
    """Payload shape: optional unit struct, arrays never null, decimals as numbers."""
    unit = F.struct(F.col("unit_ref").alias("ref"),
                    F.element_at(F.split("unit_ref", "/"), -1).alias("slug"),
                    F.col("unit_name").alias("name"), F.col("unit_type").alias("type"))
    return df.select(
        "ref", "site", F.element_at(F.split("ref", "/"), -1).alias("slug"),
        F.col("program_slug").alias("program"), "source_name", *_given(df, "local_name"),
        F.when(F.col("unit_ref").isNotNull(), unit).alias("unit"), _strings(df, "majors"),
        F.col("years").cast("double").alias("years"), "status",
        *_given(df, "curriculum_url", "accreditation"),
        *[c for c in ("provenance",) if c in df.columns])


def present_program(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("slug").alias("ref"), "slug", *_given(df, "code"), "name", _strings(df, "aliases"),
        "level", *_given(df, "discipline", "description"),
        F.col("typical_years").cast("double").alias("typical_years"),
        *[c for c in ("offerings", "provenance") if c in df.columns])


def select_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sparse fieldsets; the pruning reaches the scan. Unknown names are an error."""
    unknown = [f for f in fields if f not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {unknown}")
    return df.select(*fields)


def changes(events: DataFrame, since: tuple[object, int] | None = None,
            entity_type: str | None = None, limit: int = K.PAGE_SIZE) -> DataFrame:
    """Change feed after (occurred_at, id), oldest first."""
    rows = listing(events, {"entity_type": entity_type})
    if since is not None:
        at, last_id = F.lit(since[0]), F.lit(since[1])
        # The first comparison alone reaches the scan.
        rows = rows.filter((F.col("occurred_at") >= at) & (
            (F.col("occurred_at") > at) | (F.col("id") > last_id)))
    return rows.orderBy("occurred_at", "id").limit(limit)


def list_announcements(rows: DataFrame, *, site: str | None = None, category: str | None = None,
                       start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Newest first, undated last."""
    rows = listing(rows, {"site": site, "category": category})
    if start is not None:
        rows = rows.filter(F.col("published_at") >= start)
    if end is not None:
        rows = rows.filter(F.col("published_at") < end)
    return rows.orderBy(F.desc_nulls_last("published_at"), "ref")


def result_digest(df: DataFrame, *ignored: str) -> DataFrame:
    """Fingerprint of a result that ignores row order and the named assembly columns.

    Row digests are added up as integers, so the fold is combined map-side and no ordering or
    gathering of rows takes place.
    """
    columns = sorted(c for c in df.columns if c not in ignored)
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    return digest_of_digests(df.select(row.alias("digest")))


def digest_of_digests(digests: DataFrame) -> DataFrame:
    def part(start: int) -> Column:
        word = F.conv(F.substring("digest", start, 8), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(word), F.lit(0)).cast("string")
    words = [part(1 + 8 * i) for i in range(8)]
    return digests.agg(F.count(F.lit(1)).alias("rows"), F.sha2(
        F.concat_ws("-", F.count(F.lit(1)).cast("string"), *words), 256).alias("fingerprint"))


def fee_totals(fees: DataFrame, items: str = "line_items") -> DataFrame:
    """Total of JSON line items [{label, amount}], exact decimals."""
    parsed = F.from_json(items, "array<struct<label:string,amount:decimal(12,2)>>")
    zero = F.lit(0).cast("decimal(12,2)")
    total = F.aggregate(parsed, zero, lambda acc, x: (
        acc + F.coalesce(x["amount"], zero)).cast("decimal(12,2)"))
    return fees.withColumn("total_estimate", total)


def procedure_steps(procedures: DataFrame, steps: str = "steps") -> DataFrame:
    """Steps of a procedure as rows, from JSON [{n, title, detail}]."""
    parsed = F.from_json(steps, "array<struct<n:int,title:string,detail:string>>")
    return procedures.select(
        *[c for c in procedures.columns if c != steps],
        F.posexplode(parsed).alias("step_pos", "step")).select(
        "*", "step.n", "step.title", "step.detail").drop("step")
