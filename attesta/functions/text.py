"""Name and text functions: cleaning, slugs, normal forms, trigrams."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace as browsers' regular expressions see it: Unicode space, the byte-order mark, and
# not the next-line control.
_SPACE = r"(?U)[\s\x{FEFF}&&[^\x85]]+"


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters whose NFKD form is one ASCII letter or digit plus combining marks, with that
    letter; and those that expand to more, with their whole NFKD form. Names are in lower case
    before they fold, and a capital that comes out of the folding is a separator."""
    source, target, many = [], [], {}
    for point in range(0x80, 0x30000):  # no character above these planes decomposes
        char = chr(point)
        if not unicodedata.decomposition(char) or char != char.lower():
            continue
        full = unicodedata.normalize("NFKD", char)
        bare = [c for c in full if not "\u0300" <= c <= "\u036f"]
        if not any(c in _KEPT for c in bare):
            continue
        if len(bare) == 1:
            source.append(char)
            target.append(bare[0])
        else:
            many[char] = full
    return "".join(source), "".join(target), many


_KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_FOLD_FROM, _FOLD_TO, _MANY = _fold_tables()
_MANY_JSON = json.dumps(_MANY, ensure_ascii=False)


def _class_of(chars: str) -> str:
    """A pattern for one of the characters, neighbours as ranges: fewer tests per character."""
    ranges = []
    for point in sorted(map(ord, chars)):
        if ranges and point == ranges[-1][1] + 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


_MANY_CLASS = _class_of("".join(_MANY))
_BEYOND_ASCII = r"[^\x00-\x7F]"
# Characters that fold without leaving a mark behind (full-width forms, superscripts).
_PLAIN = [(c, t) for c, t in zip(_FOLD_FROM, _FOLD_TO) if len(unicodedata.normalize("NFKD", c)) == 1]
_PLAIN_FROM, _PLAIN_TO = "".join(c for c, _ in _PLAIN), "".join(t for _, t in _PLAIN)


def clean(col: Column) -> Column:
    """Collapse whitespace runs, non-breaking spaces included, and trim."""
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def _once(col: Column, work: Callable[[Column], Column]) -> Column:
    """`work` over the value under a name: it is worked out once, not once per use."""
    return F.get(F.transform(F.array(col), work), F.lit(0))


def _expand(col: Column) -> Column:
    """Ligatures, fractions and the like written out; texts without them pass as they are."""
    return _once(col, _written_out)


def _written_out(text: Column) -> Column:
    many = F.from_json(F.lit(_MANY_JSON), "map<string,string>")
    found = F.concat(F.regexp_extract_all(text, F.lit(_MANY_CLASS), F.lit(0)), F.array(F.lit("")))
    parts = F.zip_with(F.split(text, _MANY_CLASS), found, lambda part, c: F.concat(
        part, F.coalesce(F.try_element_at(many, c), c)))
    foreign = F.regexp(text, F.lit(_BEYOND_ASCII)) & F.regexp(text, F.lit(_MANY_CLASS))
    return F.when(foreign, F.array_join(parts, "")).otherwise(text)


def slugify(col: Column) -> Column:
    """Page slug: combining marks become separators; never truncated.

    Any other character beyond ASCII turns into a separator anyway, so one is put behind all
    of them before accented letters fold to their base.
    """
    plain = F.translate(_expand(F.lower(clean(col))), _PLAIN_FROM, _PLAIN_TO)
    marked = F.regexp_replace(plain, r"([^\x00-\x7F])", "$1-")
    folded = F.translate(marked, _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalize_name(col: Column) -> Column:
    """Matching form: lower case, marks stripped, other runs to one space."""
    folded = F.translate(_expand(F.lower(col)), _FOLD_FROM, _FOLD_TO)
    bare = F.regexp_replace(folded, r"[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def name_slug(col: Column) -> Column:
    return F.replace(normalize_name(col), F.lit(" "), F.lit("-"))


def normalize_name_exact(col: Column) -> Column:
    """The same by Python's own NFKD, to hold the native form against."""
    def normalize(names: pd.Series) -> pd.Series:
        folded = names.str.lower().str.normalize("NFKD")
        bare = folded.str.replace("[\u0300-\u036f]", "", regex=True)
        return bare.str.replace("[^a-z0-9]+", " ", regex=True).str.strip()

    # Made on use: a module-level UDF would hold a handle of one session.
    return F.pandas_udf(normalize, T.StringType())(col)


# A character reference: numbers and names; a name without its semicolon must end there.
_REFERENCE = (r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+(?:;|(?![A-Za-z0-9=])))")
_COMMON = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "amp": "&"}
_RARE = "&(?!(?:" + "|".join(_COMMON) + ");)(?:#|[A-Za-z])"


def _references() -> str:
    """What a reference stands for, by what follows its ampersand. Numbers from 128 to 159 mean
    the characters that Windows has there."""
    named = {**html5, "nbsp;": " ", "nbsp": " "}
    for point in range(128, 160):
        named[f"#{point}"] = bytes([point]).decode("cp1252", "ignore") or chr(point)
    return json.dumps(named, ensure_ascii=False)


_REFERENCES = _references()


def unescape(col: Column) -> Column:
    """Character references decoded once: all names, decimal and hexadecimal numbers. An
    unknown name stays as it is; a number that is no character gives the replacement mark."""
    known = F.from_json(F.lit(_REFERENCES), "map<string,string>")

    def meaning(ref: Column) -> Column:
        body = F.regexp_replace(ref, "^&|;$", "")
        point = F.when(F.regexp(body, F.lit("^#[xX]")), F.conv(F.substring(body, 3, 99), 16, 10)
                       ).otherwise(F.substring(body, 2, 99)).try_cast("long")
        fine = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        safe = F.when(F.coalesce(fine, F.lit(False)), point).otherwise(0xFFFD)
        char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
        low = F.try_element_at(known, F.concat(F.lit("#"), safe.cast("string")))
        return F.when(ref == "", "").when(F.startswith(body, F.lit("#")), F.coalesce(
            low, char)).otherwise(F.coalesce(F.try_element_at(known, F.substring(ref, 2, 99)), ref))

    def whole(text: Column) -> Column:
        refs = F.concat(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(text, _REFERENCE), refs,
                                       lambda part, ref: F.concat(part, meaning(ref))), "")

    def common(text: Column) -> Column:
        for name, char in _COMMON.items():  # the ampersand last, so nothing is decoded twice
            text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
        return text

    return _once(col, lambda text: F.when(F.regexp(text, F.lit(_RARE)), whole(text)).otherwise(
        common(text)))


def last_segment(col: Column) -> Column:
    """Last non-empty path segment of a link, '' when there is none."""
    path = F.split(col, "[?#]", 2)[0]
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(-1)),
                      F.lit(""))


def majors_of(col: Column) -> Column:
    """Tail after "major(s) in", else after "with specialization(s) in", as an array."""
    major = F.regexp_extract(col, r"(?i)\bmajors?\s+in\s+(.+)$", 1)
    special = F.regexp_extract(col, r"(?i)\bwith\s+specializations?\s+in\s+(.+)$", 1)
    tail = F.when(major != "", major).otherwise(special)
    return F.when(F.coalesce(tail, F.lit("")) != "", F.array(clean(tail))).otherwise(
        F.array().cast("array<string>"))


def years_of(col: Column) -> Column:
    """Years stated in the text, in (0, 12]; anything else is null, never a default."""
    value = F.regexp_extract(col, r"(?i)(\d+(?:\.\d+)?)\s*year", 1).try_cast("double")
    return F.when((value > 0) & (value <= 12), value.cast("decimal(3,1)"))


def tokens(col: Column) -> Column:
    """Lower-cased words, no stemming."""
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(col: Column) -> Column:
    """Distinct 3-grams of the words, each padded with two spaces left and one right."""
    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1),
                           lambda i: F.substring(padded, i, 3))
    return F.array_distinct(F.flatten(F.transform(tokens(col), grams)))


def similarity_of_grams(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return similarity_of_grams(trigrams(a), trigrams(b))


def contains_ci(col: Column, text: str) -> Column:
    """Case-insensitive substring; % and _ in the text keep their wildcard meaning."""
    return F.ilike(col, F.lit(f"%{text}%"))
