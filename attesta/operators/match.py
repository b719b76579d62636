"""Name resolution: exact, normalized, trigram, unmatched; and merging by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions import text as X
from attesta.operators.similar import most_similar
from attesta.session import materialize


def candidates(registry: DataFrame, form=lambda c: c) -> DataFrame:
    """(candidate, slug): every name, alias and slug; the earliest entry owns a string.

    Reduced to one row per string, so joining names to it can never multiply them.
    """
    strings = F.array_distinct(F.concat(
        F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")),
        F.array("slug")))
    return (registry.select("slug", "ord", F.explode(F.transform(strings, form))
                            .alias("candidate"))
            .filter(F.col("candidate") != "").groupBy("candidate")
            .agg(F.min_by("slug", F.struct("ord", "slug")).alias("slug")))


def match_exact(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    known = candidates(registry).withColumnRenamed("slug", "match_slug")
    return names.join(known, F.trim(F.col(name)) == F.col("candidate"), "left").drop("candidate")


def match_normalized(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    known = candidates(registry, X.normalize_name).withColumnRenamed("slug", "match_slug")
    # The generator settles the form, so that the join's filters do not repeat the expression.
    formed = names.select("*", F.explode(F.array(X.normalize_name(F.col(name)))).alias("_form"))
    return formed.join(known, F.col("_form") == F.col("candidate"), "left").drop(
        "_form", "candidate")


def _identified(texts: DataFrame) -> DataFrame:
    """Distinct texts under a 16-byte id, so that joins move ids instead of texts."""
    return texts.select("text").distinct().withColumn("id", F.unhex(F.md5("text")))


def _gram_sets(texts: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, grams): the distinct grams of each text, rarest first."""
    grams = texts.select("id", F.explode(X.trigrams(F.col("text"))).alias("gram"))
    return grams.join(frequency, "gram", "left").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))).alias("_g")).select(
        "id", F.col("_g.gram").alias("grams"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float,
                  inclusive: bool = True) -> DataFrame:
    """All pairs of distinct texts (column `text` on both sides) with trigram similarity at
    or above the threshold, as (left_text, right_text, score). Exact.

    Two sets reach similarity t only if their sizes lie within a factor t of each other and,
    under one global order of grams, they share one of the first `n - ceil(t*n) + 1` of each.
    So only those grams, the rarest, are joined. The places of the first shared gram also bound
    how many grams can follow, which drops most of the pairs that remain; the rest are verified
    on their full sets. Texts are made distinct first, so copies never multiply candidates.
    """
    left, right = _identified(left), _identified(right)
    frequency = right.select(F.explode(X.trigrams(F.col("text"))).alias("gram")).groupBy(
        "gram").agg(F.count(F.lit(1)).alias("freq"))
    left_sets, right_sets = _gram_sets(left, frequency), _gram_sets(right, frequency)

    def prefix(sets: DataFrame, side: str) -> DataFrame:
        size = F.size("grams")
        # The small constant only widens the filters, against rounding of t*n.
        first = size - F.ceil(threshold * size - 1e-9) + 1
        return sets.select(
            F.col("id").alias(f"{side}_id"), size.alias(f"{side}_size"),
            F.posexplode(F.slice("grams", 1, first.cast("int"))).alias(f"{side}_place", "gram"))

    l_size, r_size = F.col("left_size"), F.col("right_size")
    close = (l_size >= threshold * r_size - 1e-9) & (r_size >= threshold * l_size - 1e-9)
    still = F.least(l_size - F.col("left_place"), r_size - F.col("right_place"))
    enough = still >= threshold / (1 + threshold) * (l_size + r_size) - 1e-9
    pairs = (prefix(left_sets, "left").join(prefix(right_sets, "right"), "gram")
             .filter(close & enough).select("left_id", "right_id").distinct())
    score = X.similarity_of_grams(F.col("left_grams"), F.col("right_grams"))
    scored = (pairs.join(left_sets.toDF("left_id", "left_grams"), "left_id")
              .join(right_sets.toDF("right_id", "right_grams"), "right_id")
              .select("left_id", "right_id", score.alias("score")))
    keep = F.col("score") >= threshold if inclusive else F.col("score") > threshold
    return (scored.filter(keep)
            .join(left.select(F.col("id").alias("left_id"), F.col("text").alias("left_text")),
                  "left_id")
            .join(right.select(F.col("id").alias("right_id"), F.col("text").alias("right_text")),
                  "right_id").select("left_text", "right_text", "score"))


def match_trigram(names: DataFrame, registry: DataFrame, threshold: float = K.TRIGRAM_THRESHOLD,
                  name: str = "name") -> DataFrame:
    """Best registry entry by name at or above the threshold: (name, match_slug, score)."""
    entries = registry.groupBy(F.col("name").alias("right_text")).agg(
        F.min_by("slug", F.struct("ord", "slug")).alias("slug"), F.min("ord").alias("ord"))
    pairs = similar_pairs(names.select(F.col(name).alias("text")),
                          registry.select(F.col("name").alias("text")), threshold)
    best = pairs.join(entries, "right_text").groupBy(F.col("left_text").alias(name)).agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "ord", "slug")).alias("_best"))
    return best.select(name, F.col("_best.slug").alias("match_slug"),
                       (-F.col("_best.neg")).alias("score"))


def resolve_names(names: DataFrame, registry: DataFrame, name: str = "name",
                  threshold: float = K.TRIGRAM_THRESHOLD) -> DataFrame:
    """Every row of `names` with match_slug, match_method and score.

    The chain runs over distinct names only, each step over what the one before left over, and
    never invents a registry row. A name carried by many rows meets its single resolution in
    one join, whose hot side adaptive execution can split. The forms are written once, while the
    frame is built: the rest of the chain reads them several times.
    """
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct()
    by_form = materialize(match_normalized(
        match_exact(distinct, registry, name).withColumnRenamed("match_slug", "_exact"),
        registry, name).withColumnRenamed("match_slug", "_normal"), "names-by-form")
    residue = by_form.filter(F.col("_exact").isNull() & F.col("_normal").isNull())
    fuzzy = match_trigram(residue, registry, threshold, name).withColumnRenamed(
        "match_slug", "_fuzzy")
    resolved = by_form.join(fuzzy, name, "left").select(
        name, F.coalesce("_exact", "_normal", "_fuzzy").alias("match_slug"),
        F.when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_normal").isNotNull(), "normalized")
        .when(F.col("_fuzzy").isNotNull(), "trigram").otherwise("unmatched")
        .alias("match_method"),
        F.when(F.col("_exact").isNull() & F.col("_normal").isNull(), F.col("score"))
        .alias("match_score"))
    return names.join(resolved, name, "left").withColumn(
        "match_method", F.coalesce("match_method", F.lit("unmatched")))


def did_you_mean(queries: DataFrame, dictionary: DataFrame, columns: Sequence[str],
                 query: str = "query", threshold: float = K.SUGGEST_THRESHOLD,
                 limit: int = K.SUGGEST_LIMIT) -> DataFrame:
    """Top suggestions per missed query over one or more dictionary columns.

    Columns: query, slug, score, place. The greatest similarity over the columns counts. All
    columns are one pass over one set of texts, whose trigrams are worked out once.
    """
    entries = dictionary.select(F.col("slug").alias("key"), F.explode(F.array(*columns))
                                .alias("text"))
    found = most_similar(queries.select(F.col(query).alias("text")), entries, limit, threshold)
    return found.select(F.col("text").alias(query), F.col("key").alias("slug"), "score", "place")


def unmatched(offerings: DataFrame, sources: DataFrame) -> DataFrame:
    """Offerings with no canonical entry, ordered for the person who will resolve them."""
    return (offerings.filter(F.col("program_slug").isNull())
            .join(sources.select("source_id", F.col("url").alias("source_url")), "source_id")
            .orderBy("site", "source_name"))


def distinct_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      array: str) -> DataFrame:
    """Ordered distinct union of an array column per key.

    Elements are reduced to (key, element, first place) before anything is gathered, so a key
    with very many rows is combined map-side and only its distinct elements come together.
    """
    items = df.select(*keys, F.struct(*order).alias("_pos"),
                      F.posexplode(array).alias("_idx", "_item"))
    first = items.groupBy(*keys, "_item").agg(
        F.min(F.struct("_pos", "_idx")).alias("_place"))
    return first.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_place", "_item"))),
        lambda s: s["_item"]).alias(array))


def merge_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 arrays: Sequence[str] = ()) -> DataFrame:
    """Merge rows with one key: the first row's scalars, arrays united in order."""
    scalars = [c for c in df.columns if c not in keys and c not in arrays]
    merged = df.groupBy(*keys).agg(
        F.min_by(F.struct(*scalars), F.struct(*order)).alias("_first"),
        F.count(F.lit(1)).alias("merged_rows"))
    out = merged.select(*keys, "_first.*", "merged_rows")
    for array in arrays:
        out = out.join(distinct_in_order(df, keys, order, array), list(keys), "left").withColumn(
            array, F.coalesce(array, F.array().cast(df.schema[array].dataType)))
    return out


def attach_dimension(df: DataFrame, dimension: DataFrame, key: str,
                     columns: Sequence[str]) -> DataFrame:
    """Foreign-key resolution; a missing key gives null. `dimension` is unique on `key`."""
    return df.join(dimension.select(key, *columns), key, "left")


