import datetime as dt
import itertools
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import confidence as C
from attesta.functions import hashing as H
from attesta.functions import sql as S
from attesta.functions import text as X
from attesta.functions import urls as U


def one(spark, column, **values):
    """Value of a column expression over one row."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) \
        if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


def test_clean_collapses_every_kind_of_space(spark):
    assert one(spark, X.clean(F.col("x")), x="  a  b\r\n\tc﻿ ") == "a b c"


@pytest.mark.parametrize("text, slug, normal", [
    ("Bachelor of Science", "bachelor-of-science", "bachelor of science"),
    ("  Éducation & Café ", "e-ducation-cafe", "education cafe"),
    ("Año 2024!", "an-o-2024", "ano 2024"),
    ("A--B__C", "a-b-c", "a b c"),
    ("²ｘ", "2x", "2x"),
    ("日本", "", ""),
])
def test_slug_and_normal_form_treat_marks_differently(spark, text, slug, normal):
    assert one(spark, X.slugify(F.col("x")), x=text) == slug
    assert one(spark, X.normalize_name(F.col("x")), x=text) == normal
    assert one(spark, X.name_slug(F.col("x")), x=text) == normal.replace(" ", "-")


def test_slug_is_never_truncated(spark):
    long = "Major in Mechanical Engineering Technology " * 6
    a, b = long + "option in Foundry", long + "option in Welding"
    assert one(spark, X.slugify(F.col("x")), x=a) != one(spark, X.slugify(F.col("x")), x=b)


def test_native_forms_agree_with_full_decomposition(spark):
    rng = random.Random(7)
    letters = "abcXYZ 0-éÉñÑüßøÅç.,/́"
    names = ["".join(rng.choice(letters) for _ in range(20)) for _ in range(200)]

    def slug(name):
        flat = unicodedata.normalize("NFKD", re.sub(r"\s+", " ", name).strip().lower())
        return re.sub(r"[^a-z0-9]+", "-", flat).strip("-")

    df = spark.createDataFrame([(n,) for n in names], "x string")
    for row in df.select("x", X.slugify(F.col("x")).alias("s"), X.normalize_name(F.col("x"))
                         .alias("n"), X.normalize_name_exact(F.col("x")).alias("e")).collect():
        assert row.s == slug(row.x)
        assert row.n == row.e


def test_exact_form_expands_ligatures(spark):
    assert one(spark, X.normalize_name_exact(F.col("x")), x="ﬁne ½") == "fine 1 2"


@pytest.mark.parametrize("href, segment", [
    ("/a/b/c", "c"), ("https://h.org/a/b/?q=1#z", "b"), ("x.html", "x.html"), ("/", ""), ("", "")])
def test_last_segment(spark, href, segment):
    assert one(spark, X.last_segment(F.col("x")), x=href) == segment


@pytest.mark.parametrize("name, majors", [
    ("BET major in  Foundry", ["Foundry"]), ("BS: Majors in A and B", ["A and B"]),
    ("BS with specialization in Q", ["Q"]), ("BS with specializations in Q", ["Q"]),
    ("Major in X option in Y", ["X option in Y"]), ("Civil Engineering", [])])
def test_majors(spark, name, majors):
    assert one(spark, X.majors_of(F.col("x")), x=name) == majors


@pytest.mark.parametrize("text, years", [
    ("4 years", 4), ("4.5 Years", 4.5), ("12 years", 12), ("13 years", None), ("0 year", None),
    ("four years", None), ("", None)])
def test_years_are_never_defaulted(spark, text, years):
    got = one(spark, X.years_of(F.col("x")), x=text)
    assert (None if got is None else float(got)) == years


def test_trigram_similarity_follows_its_definition(spark):
    def grams(text):
        out = set()
        for word in re.findall(r"[^\W_]+", text.lower()):
            padded = f"  {word} "
            out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
        return out

    rng = random.Random(3)
    words = ["civil", "Civic", "engineering", "enginering", "Science", "é", "42", "x-y"]
    pairs = [(" ".join(rng.sample(words, 3)), " ".join(rng.sample(words, 3))) for _ in range(60)]
    df = spark.createDataFrame(pairs + [("", "")], "a string, b string")
    for row in df.select("a", "b", X.trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        a, b = grams(row.a), grams(row.b)
        assert row.s == pytest.approx(len(a & b) / len(a | b) if a | b else 0.0)


@pytest.mark.parametrize("url, normal", [
    ("https://A.org/x/", "https://a.org/x"), ("https://a.org", "https://a.org/"),
    ("https://a.org/x//?q=1#f", "https://a.org/x?q=1"), ("http://a.org:80/x", "http://a.org/x"),
    ("https://a.org:8443/x", "https://a.org:8443/x"), ("https://a.org/x?", "https://a.org/x"),
    ("not a url", "not a url")])
def test_normalize_url(spark, url, normal):
    assert one(spark, U.normalize_url(F.col("x")), x=url) == normal


def test_signal_map_and_permission(spark):
    parsed = one(spark, U.signal_map(F.col("x")), x="Search=Yes, ai-train=no ,use=a=b,,=z,search=no")
    assert parsed == {"search": "no", "ai-train": "no", "use": "a=b"}
    permits = U.signal_permits(U.signal_map(F.col("x")))
    for text, allowed in [("search=yes,ai-train=no", True), ("ai-input=no", False),
                          ("search=no,use=no", False), ("search=no", True), ("", True)]:
        assert one(spark, permits, x=text) is allowed


def test_record_hash_ignores_field_order_and_absent_values(spark):
    a, b, none = F.lit("x"), F.lit(1), F.lit(None).cast("string")
    row = spark.range(1).select(H.record_hash(a=a, b=b).alias("h1"), H.record_hash(b=b, a=a).alias(
        "h2"), H.record_hash(a=a, b=b, c=none).alias("h3"), H.record_hash(a=a, b=F.lit(2)).alias("h4")).first()
    assert row.h1 == row.h2 == row.h3 != row.h4


NOW = dt.datetime(2026, 8, 29, 12)


def level(method, kind, days, status="active", unreachable=0, effective=None, superseded=False):
    """The policy restated by hand."""
    rank = {"low": 0, "medium": 1, "high": 2}
    value = rank[K.BASE_BY_METHOD[method]]
    value = min(value, rank[K.CAP_BY_ENTITY.get(kind, "high")])
    if days >= K.DECAY_TO_LOW.get(kind, 10 ** 9):
        value = 0
    elif days >= K.DECAY_TO_MEDIUM.get(kind, 10 ** 9):
        value = min(value, 1)
    if kind == "document" and (superseded or (
            effective and (NOW - effective).total_seconds() > 3 * 365 * 86400)):
        return "low"
    if status in ("unavailable", "blocked"):
        value = 0 if unreachable >= 30 else min(value, 1)
    return K.CONFIDENCE_LEVELS[value]


def test_confidence_over_the_whole_policy(spark):
    rows = []
    for kind, method in itertools.product(K.ENTITY_TYPES, K.INGEST_METHODS):
        edges = {0, K.DECAY_TO_MEDIUM.get(kind, 50), K.DECAY_TO_LOW.get(kind, 400)}
        for days in sorted({d + s for d in edges for s in (-1, 0)} - {-1}):
            for status, gone in [("active", 99), ("unavailable", 0), ("blocked", 29),
                                 ("blocked", 30), ("suspended", 50)]:
                rows.append((method, kind, days, status, gone, None, False))
    for age in (1095, 1096):
        rows.append(("crawl", "document", 0, "active", 0, NOW - dt.timedelta(days=age), False))
        rows.append(("crawl", "program", 0, "active", 0, NOW - dt.timedelta(days=age), False))
    rows.append(("crawl", "document", 0, "active", 0, None, True))
    df = spark.createDataFrame(rows, "method string, kind string, days int, status string, "
                                     "gone int, effective timestamp, superseded boolean")
    got = df.withColumn("level", C.confidence(
        F.col("method"), F.col("kind"), F.col("days"), now=F.lit(NOW),
        effective_date=F.col("effective"), superseded=F.col("superseded"),
        source_status=F.col("status"), unreachable_days=F.col("gone")))
    for r in got.collect():
        assert r.level == level(r.method, r.kind, r.days, r.status, r.gone, r.effective,
                                r.superseded), r


def test_staleness_is_floored_and_never_negative(spark):
    for back, days in [(0, 0), (86399, 0), (86400, 1), (-500, 0), (10 * 86400 - 1, 9)]:
        got = one(spark, C.staleness_days(F.lit(NOW - dt.timedelta(seconds=back)), F.lit(NOW)))
        assert got == days


def test_levels_compare_by_rank_not_by_name(spark):
    assert one(spark, C.lower_of(F.lit("high"), F.lit("low"))) == "low"
    assert one(spark, C.lower_of(F.lit("medium"), F.lit("high"))) == "medium"
    df = spark.createDataFrame([("low",), ("medium",), ("high",)], "c string")
    assert {r.c for r in df.filter(C.at_least(F.col("c"), "medium")).collect()} == {"medium", "high"}


def test_sql_functions_agree_with_columns(spark):
    S.register(spark)
    text = "Élan  Café major in X, 4.5 years"
    row = spark.sql(f"""SELECT clean('{text}') c, slugify('{text}') s, normalize_name('{text}') n,
      majors_of('{text}') m, years_of('{text}') y, conf_rank('medium') r,
      trigram_similarity('word', 'words') t""").first()
    assert row.c == one(spark, X.clean(F.col("x")), x=text)
    assert row.s == one(spark, X.slugify(F.col("x")), x=text)
    assert row.n == one(spark, X.normalize_name(F.col("x")), x=text)
    assert row.m == one(spark, X.majors_of(F.col("x")), x=text)
    assert row.y == one(spark, X.years_of(F.col("x")), x=text)
    assert (row.r, row.t) == (1, pytest.approx(4 / 7))
