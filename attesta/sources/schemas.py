"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns every published entity carries.
PROVENANCE_DDL = ("source_id string, content_hash string, first_seen_at timestamp, "
                  "last_verified_at timestamp, confidence string, miss_count int")

_ENTITY_DDL = {
    "campus": "site string, name string, short_name string, kind string, website string, "
              "website_status string, address struct<street:string,city:string,"
              "province:string,region:string,postal:string>, established int, "
              "description string",
    "academic_unit": "site string, slug string, parent_ref string, name string, "
                     "abbreviation string, unit_type string, description string, "
                     "head_name string, head_title string, emails array<string>, "
                     "website string, status string",
    "program": "slug string, code string, name string, aliases array<string>, level string, "
               "discipline string, description string, typical_years decimal(3,1)",
    "program_offering": "site string, slug string, program_slug string, unit_ref string, "
                        "source_name string, local_name string, majors array<string>, "
                        "years decimal(3,1), status string, accreditation string, "
                        "curriculum_url string",
    "office": "site string, slug string, name string, abbreviation string, category string, "
              "description string, location string, emails array<string>, "
              "phones array<string>, hours string, services array<string>, website string",
    "official": "site string, slug string, office_ref string, name string, title string, "
                "scope string, email string, photo_url string, is_current boolean",
    "announcement": "site string, slug string, source_key string, title string, "
                    "summary string, body_md string, category string, "
                    "published_at timestamp, url string, image_url string",
    "document": "site string, slug string, title string, doc_type string, edition string, "
                "effective_date date, format string, url string, storage_key string, "
                "page_count int, body_md string, is_superseded boolean",
    "scholarship": "site string, slug string, name string, category string, grantor string, "
                   "benefits string, eligibility string, requirements array<string>, "
                   "application_process string, contact_office_ref string, "
                   "source_dated string",
    "fee_estimate": "site string, program_slug string, academic_year string, "
                    "student_type string, currency string, line_items string, "
                    "total_estimate decimal(12,2), notes string",
    "procedure": "site string, slug string, title string, category string, audience string, "
                 "steps string, requirements array<string>, office_ref string, "
                 "effective_ay string",
}


def entity_schema(entity_type: str) -> T.StructType:
    return T.StructType.fromDDL(f"ref string, {_ENTITY_DDL[entity_type]}, {PROVENANCE_DDL}")


# The tables the checks run on.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

MANIFEST_DDL = (
    "files array<struct<file:string,url:string,collected_at:timestamp,collected_by:string,"
    "sha256:string,content_type:string,http_status:int,note:string>>")
