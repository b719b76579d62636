"""URL, wildcard and usage-signal functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?"
_DEFAULT_PORT = r"^(http://.*):80$|^(https://.*):443$"


def scheme_of(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, _URL, 1))


def origin_of(col: Column) -> Column:
    """Scheme and host with any non-default port; null when the URL does not parse."""
    start = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    bare = F.regexp_replace(F.lower(start), "//[^@]*@", "//")
    origin = F.regexp_replace(bare, _DEFAULT_PORT, "$1$2")
    return F.when(F.try_parse_url(col, F.lit("HOST")).isNotNull(), origin)


def host_of(col: Column) -> Column:
    return F.nullif(F.regexp_extract(origin_of(col), "://(.*)$", 1), F.lit(""))


def path_and_query(col: Column) -> Column:
    """What robots rules are matched against: path (at least "/") plus query."""
    path = F.regexp_replace(F.regexp_extract(col, _URL, 3), "^$", "/")
    return F.concat(path, query_of(col))


def query_of(col: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(col, _URL, 4), r"^\?$", "")


def normalize_url(col: Column) -> Column:
    """Drop trailing slashes, default ports and fragments; keep the query.

    Text that is not an absolute URL stays as it is.
    """
    path = F.regexp_replace(F.regexp_extract(col, _URL, 3), "/+$", "")
    normal = F.concat(origin_of(col), F.regexp_replace(path, "^$", "/"), query_of(col))
    return F.coalesce(normal, col)


def wildcard_regex(pattern: Column, end_anchor: Column) -> Column:
    """Anchored regular expression for a pattern whose only wildcard is `*`."""
    quoted = F.regexp_replace(pattern, r"([.+?^${}()|\[\]\\])", r"\\$1")
    body = F.replace(quoted, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), body, F.when(end_anchor, "$").otherwise(""))


def wildcard_to_regex(pattern: str) -> str:
    return "^" + ".*".join(re.escape(part) for part in pattern.split("*")) + "$"


def signal_map(col: Column) -> Column:
    """`k=v,k=v` text as a map of trimmed lower-case entries; the last key wins."""
    pairs = F.transform(F.split(F.lower(col), ","), lambda part: F.struct(
        F.trim(F.split(part, "=", 2)[0]).alias("key"),
        F.trim(F.coalesce(F.get(F.split(part, "=", 2), F.lit(1)), F.lit(""))).alias("value")))
    named = F.filter(pairs, lambda p: p["key"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(
        F.slice(named, i + 2, F.size(named)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def signal_permits(signal: Column) -> Column:
    """Use is refused by `ai-input=no`, or by `search=no` together with `use=no`."""
    def says_no(key: str) -> Column:
        return F.coalesce(F.try_element_at(signal, F.lit(key)) == "no", F.lit(False))
    return ~(says_no("ai-input") | (says_no("search") & says_no("use")))


def resolve(base: Column, href: Column) -> Column:
    """A link as an absolute http(s) URL; null for other schemes and for places in the page."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(F.regexp(page, F.lit(r"^[^/]*//[^/]*$")), F.concat(page, F.lit("/"))).otherwise(
        F.regexp_replace(page, "[^/]*$", ""))
    joined = (F.when(F.regexp(href, F.lit(r"(?i)^https?://")), href)
              .when(F.regexp(href, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:")), F.lit(None))
              .when(F.regexp(href, F.lit("^(#|$)")), F.lit(None))
              .when(F.startswith(href, F.lit("//")),
                    F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href))
              .when(F.startswith(href, F.lit("/")), F.concat(origin_of(base), href))
              .when(F.startswith(href, F.lit("?")), F.concat(page, href))
              .otherwise(F.concat(folder, href)))
    head = F.regexp_extract(joined, "^[^/]*//[^/?#]*", 0)
    tail = F.regexp_extract(joined, "^[^/]*//[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(joined, r"([?#].*)$", 1)
    # A last dot segment names a folder.
    parts = F.split(F.regexp_replace(tail, r"(/\.\.?)$", "$1/"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, part: F.when(
        part == ".", out).when(
        part == "..", F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out))
        .otherwise(F.array_append(out, part)))
    return F.when(F.regexp(tail, F.lit(r"/\.")), F.concat(head, F.array_join(kept, "/"), rest)
                  ).otherwise(joined)
