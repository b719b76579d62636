import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import match as M
from attesta.operators import validate as V

REGISTRY = [
    ("bsce", "Bachelor of Science in Civil Engineering", ["BSCE", "BS Civil Eng."], 1),
    ("bsme", "Bachelor of Science in Mechanical Engineering", [], 2),
    ("bscpe", "Bachelor of Science in Computer Engineering", ["BSCE"], 3),
]


@pytest.fixture
def registry(spark):
    return spark.createDataFrame(
        REGISTRY, "slug string, name string, aliases array<string>, ord int")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def test_chain_prefers_exact_then_normalized_then_trigram(spark, registry, rows):
    got = M.resolve_names(names(
        spark, " BSCE ", "bs civil eng", "Bachelor of Science in Civil Enginering",
        "Bachelor of Arts", "bsme", "Bachelor of Arts", None), registry)
    assert rows(got, "name", "match_slug", "match_method") == sorted([
        (" BSCE ", "bsce", "exact"), ("bs civil eng", "bsce", "normalized"),
        ("Bachelor of Science in Civil Enginering", "bsce", "trigram"),
        ("Bachelor of Arts", None, "unmatched"), ("Bachelor of Arts", None, "unmatched"),
        ("bsme", "bsme", "exact"), (None, None, "unmatched")], key=repr)


def test_score_is_kept_for_trigram_only(spark, registry):
    got = {r.name: r.match_score for r in M.resolve_names(
        names(spark, "BSCE", "Bachelor of Science in Civil Enginering"), registry).collect()}
    assert got["BSCE"] is None
    assert got["Bachelor of Science in Civil Enginering"] >= 0.85


@pytest.mark.parametrize("threshold, inclusive", [(0.85, True), (0.5, True), (0.2, False), (1.0, True)])
def test_similar_pairs_equals_brute_force(spark, rows, threshold, inclusive):
    rng = random.Random(11)
    words = ["civil", "civic", "engineer", "engineering", "science", "sciences", "of", "arts", "bs"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(90)]
    left = spark.createDataFrame([(t,) for t in texts[:50]] * 2, "text string")
    right = spark.createDataFrame([(t,) for t in texts[40:]], "text string")
    got = M.similar_pairs(left, right, threshold, inclusive)
    score = X.trigram_similarity(F.col("a"), F.col("b"))
    pairs = left.distinct().toDF("a").join(right.distinct().toDF("b"), F.lit(True)).select(
        "a", "b", score.alias("s"))
    want = pairs.filter(F.col("s") >= threshold if inclusive else F.col("s") > threshold)
    assert rows(got, "left_text", "right_text") == rows(want, "a", "b")


def test_suggestions_take_the_greater_column(spark, registry, rows):
    queries = spark.createDataFrame([("bsc",)], "query string")
    got = M.did_you_mean(queries, registry, ["slug", "name"])
    best = got.orderBy("place").first()
    assert best.slug == "bsce" and got.count() <= 3
    assert best.score == pytest.approx(0.5)


def test_merge_unites_arrays_in_order_and_keeps_first_scalars(spark, rows):
    df = spark.createDataFrame([
        ("k", 2, "second", ["b", "c"]), ("k", 1, "first", ["a", "b"]), ("k", 3, "third", ["a", "d"]),
        ("e", 1, "alone", [])], "key string, pos int, name string, majors array<string>")
    got = M.merge_by_key(df, ["key"], ["pos"], ["majors"])
    assert rows(got, "key", "name", "majors", "merged_rows") == [
        ("e", "alone", [], 1), ("k", "first", ["a", "b", "c", "d"], 3)]


def record(**changes):
    base = {"entity_type": "program_offering", "source_id": "s", "source_name": "X", "slug": "x-1",
            "local_name": None, "unit_slug": None, "majors": ["m"], "years": 4.0, "status": "active"}
    return {**base, **changes}


SCHEMA = ("entity_type string, source_id string, source_name string, slug string, "
          "local_name string, unit_slug string, majors array<string>, years double, status string")


@pytest.mark.parametrize("changes, field", [
    ({}, None), ({"source_name": "  "}, "source_name"), ({"source_name": None}, "source_name"),
    ({"slug": "Bad Slug"}, "slug"), ({"slug": "a--b"}, "slug"), ({"unit_slug": "A"}, "unit_slug"),
    ({"majors": ["ok", " "]}, "majors"), ({"years": 12.0}, None), ({"years": 12.5}, "years"),
    ({"years": 0.0}, "years"), ({"years": None}, None), ({"status": "closed"}, "status"),
    ({"source_name": "", "slug": "!"}, "source_name")])
def test_first_broken_field_rejects_the_record(spark, changes, field):
    row = record(**changes)
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    valid, rejects = V.validate(df, {"program_offering": V.OFFERING_RULES})
    assert valid.count() == (field is None)
    assert [r.field for r in rejects.collect()] == ([field] if field else [])


def test_unmodelled_types_warn_once_per_source(spark, rows):
    df = spark.createDataFrame([("s1", "office"), ("s1", "office"), ("s2", "program_offering")],
                               "source_id string, entity_type string")
    assert rows(V.unmodelled_types(df, V.RECORD_RULES), "source_id", "entity_type", "records") == [
        ("s1", "office", 2)]
    assert rows(V.parsed_counts(df)) == [("office", 2), ("program_offering", 1)]


def test_strict_shape_and_defaults(spark):
    df = spark.createDataFrame([('{"slug":"a","oops":1}',), ('{"slug":"a"}',)], "record string")
    got = [r.unknown_fields for r in V.reject_unknown_fields(df, "record", ["slug"]).collect()]
    assert got == [["oops"], []]
    filled = V.fill_defaults(spark.createDataFrame([(None,)], "status string"),
                             {"status": F.lit("active"), "emails": F.array().cast("array<string>")})
    assert tuple(filled.first()) == ("active", [])


def test_personal_contacts(spark, rows):
    df = spark.createDataFrame([("a@Gmail.com",), ("b@office.edu",)], "email string")
    assert rows(V.personal_contacts(df, ["gmail.com"])) == [("a@Gmail.com",)]


def test_domain_checks_of_curated_rows(spark):
    df = spark.createDataFrame([
        ("source", "u1", "crawl", "active"), ("source", "u2", "guess", "active"),
        ("source", "u3", "seed", "dead")], "entity_type string, url string, method string, status string")
    _, rejects = V.validate(df, {"source": V.SOURCE_RULES})
    assert {(r.url, r.field) for r in rejects.collect()} == {("u2", "method"), ("u3", "status")}
