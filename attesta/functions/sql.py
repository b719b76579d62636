"""The scalar functions for SQL users, as temporary SQL functions of a session.

SQL functions are expanded into the query by the analyzer, so they run as JVM expressions just
as the column functions do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from attesta import constants as K
from attesta.functions import text as X

_YEARS = r"try_cast(regexp_extract(x, r'(?i)(\d+(?:\.\d+)?)\s*year', 1) AS DOUBLE)"
_TAIL = (r"coalesce(nullif(regexp_extract(x, r'(?i)\bmajors?\s+in\s+(.+)$', 1), ''), "
         r"regexp_extract(x, r'(?i)\bwith\s+specializations?\s+in\s+(.+)$', 1))")


def _grams(name: str) -> str:
    words = rf"filter(split(lower({name}), r'[^\p{{L}}\p{{N}}]+'), w -> w <> '')"
    each = "transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3))"
    return f"array_distinct(flatten(transform({words}, w -> {each})))"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name: (parameters, result type, body)."""
    levels = ", ".join(f"'{level}'" for level in K.CONFIDENCE_LEVELS)
    fold = f"'{X._FOLD_FROM}', '{X._FOLD_TO}'"
    shared = f"size(array_intersect({_grams('a')}, {_grams('b')}))"
    union = f"size(array_union({_grams('a')}, {_grams('b')}))"
    many = f"from_json(r'{X._MANY_JSON}', 'map<string,string>')"

    def expand(x: str) -> str:
        one = f"'{X._MANY_CLASS}'"
        return (f"CASE WHEN {x} RLIKE {one} THEN array_join(zip_with(split({x}, {one}), concat("
                f"regexp_extract_all({x}, {one}, 0), array('')), (part, c) -> concat(part, "
                f"coalesce(try_element_at({many}, c), c))), '') ELSE {x} END")

    cleaned = f"trim(regexp_replace(x, r'{X._SPACE}', ' '))"
    return {
        "clean": ("x STRING", "STRING", cleaned),
        "slugify": ("x STRING", "STRING",
                    "regexp_replace(regexp_replace(translate(regexp_replace(translate("
                    f"{expand(f'lower({cleaned})')}, '{X._PLAIN_FROM}', '{X._PLAIN_TO}'),"
                    rf" r'([^\x00-\x7F])', '$1-'), {fold}), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
        "normalize_name": ("x STRING", "STRING",
                           f"trim(regexp_replace(regexp_replace(translate({expand('lower(x)')}, {fold}),"
                           r" r'[\x{0300}-\x{036F}]', ''), '[^a-z0-9]+', ' '))"),
        "majors_of": ("x STRING", "ARRAY<STRING>",
                      f"filter(array(trim({_TAIL})), m -> m <> '')"),
        "years_of": ("x STRING", "DECIMAL(3,1)",
                     f"CASE WHEN {_YEARS} > 0 AND {_YEARS} <= 12"
                     f" THEN cast({_YEARS} AS DECIMAL(3,1)) END"),
        "staleness_days": ("verified_at TIMESTAMP, now_at TIMESTAMP", "INT",
                           "cast(greatest(0, floor(timestampdiff(SECOND, verified_at, now_at)"
                           " / 86400)) AS INT)"),
        "conf_rank": ("level STRING", "INT",
                      f"cast(array_position(array({levels}), level) AS INT) - 1"),
        "trigram_similarity": ("a STRING, b STRING", "DOUBLE",
                               f"coalesce(try_divide({shared}, {union}), 0D)"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for name, (params, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} "
                  f"RETURN {body}")
    return sorted(definitions())
