r"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Counts are taken from the whole text inside its row: no word leaves its row, so nothing is
shuffled but labels and small tables. Each rule is a ratio with a fixed list of cutoffs from
lenient to strict. The rules of a stratum (a band of lengths) go down one fixed path together:
all begin switched off, and each step gives one rule its next cutoff, in turn (`PATH`). A step
is the rejection of whatever breaks any cutoff given so far, so each step rejects all that the
one before did. Labelled good texts of the stratum are the holdout: a step holds if, were it to
reject more than its share of good texts, so few rejections as were seen would have had a
binomial probability below the corrected error level. Steps are tried in order and the first
that fails ends the trial, so the path counts as one test of all rules together; strata share
the error level by Bonferroni. Among the steps that hold, the one that separates the labels
best is used, the most lenient of equals. A stratum with too few good labels rejects nothing:
at the given risk and error the first step needs 408 good texts, none of them rejected.

Defined results: a null or word-free text has zero counts and fails the base rule; repeated
rows are judged alike; labels that are null, or contradict each other for an id, are not used;
no labels mean no cutoffs. Repeated windows are told by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import materialize

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS = 20
#: Largest share of good texts of a stratum that all rules together may reject, and the
#: probability that any stratum breaks it. Neither is divided among the rules.
RISK = 0.01
ERROR = 0.05
#: Lower bounds, in words, of the strata.
BANDS = (0, 100, 500)
#: Rules: the ratio that is too high, and its cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", (1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "repeats": ("n_repeat_words / n_words", (0.25, 0.2, 0.15, 0.1, 0.05)),
    "word_length": ("word_chars / n_words", (12.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0)),
    "lines": ("n_dup_lines / n_words", (0.3, 0.2, 0.1, 0.05, 0.03, 0.02)),
    "capitals": ("n_capitals / n_words", (5.0, 3.0, 2.0, 1.5, 1.0, 0.5)),
    "runs": ("n_runs / n_words", (0.5, 0.3, 0.2, 0.1, 0.05)),
}

#: The path: (rule, place of its cutoff), all first cutoffs, then all second ones, and so on.
PATH = tuple((name, j) for j in range(max(len(cuts) for _, cuts in RULES.values()))
             for name, (_, cuts) in RULES.items() if j < len(cuts))

# `transform(array(x), v -> f(v))[0]` evaluates x once and names it for f.
_REPEATS = f"""
CASE WHEN size(hashes) < {WINDOW} + 1 THEN 0L ELSE
transform(array(transform(sequence(0, size(hashes) - 2), i -> xxhash64(hashes[i], hashes[i + 1]))), h2 ->
transform(array(transform(sequence(0, size(h2) - 3), i -> xxhash64(h2[i], h2[i + 2]))), h4 ->
transform(array(transform(sequence(0, size(h4) - 5), i -> xxhash64(h4[i], h4[i + 4]))), h8 ->
  CASE WHEN size(array_distinct(h8)) = size(h8) THEN 0L ELSE
  transform(array(sort_array(transform(h8, (h, i) -> struct(h AS h, i AS i)))), s ->
  transform(array(sort_array(transform(
    filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h), x -> x.i))), at ->
  aggregate(transform(at, (x, k) -> least({WINDOW}, coalesce(get(at, k + 1) - x, {WINDOW}))),
            0L, (a, x) -> a + x))[0])[0]
  END)[0])[0])[0]
END"""


def _without(characters: str) -> Column:
    return F.length(F.translate("text", characters, ""))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_runs."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{k}`") for k in keep],
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, WHITE, "") != "")
    counted = rows.select(
        "doc_id", *keep,
        F.transform(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"),
                    lambda w: F.xxhash64(w)).alias("hashes"),
        _without(WHITE).cast("long").alias("word_chars"),
        (F.length("text") - _without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("text") - _without(CAPITALS)).cast("long").alias("n_capitals"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
        .cast("long").alias("n_dup_lines"))
    runs = F.transform(F.array("hashes"), lambda h: F.size(F.filter(
        h, lambda x, i: x.eqNullSafe(F.get(h, i + 1)))))[0]
    return counted.select("doc_id", *keep, F.size("hashes").cast("long").alias("n_words"),
                          "word_chars", "n_symbols", "n_dup_lines",
                          F.expr(_REPEATS).alias("n_repeat_words"), "n_capitals",
                          runs.cast("long").alias("n_runs"))


def _stratum() -> Column:
    band = F.lit(0)
    for i, least in enumerate(BANDS):
        band = F.when(F.col("n_words") >= least, i).otherwise(band)
    return band


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ln_factorial(x: str) -> str:
    """ln x! as SQL: exact to 20, then Stirling's series (error below 1e-12)."""
    return (f"CASE WHEN {x} <= 20 THEN ln(factorial(CAST({x} AS INT))) ELSE {x} * ln({x}) - {x} "
            f"+ 0.5 * ln(2 * pi() * {x}) + 1 / (12D * {x}) - 1 / (360D * power({x}, 3)) END")


def binomial_cdf(k: str, n: str, p: float) -> str:
    """P(at most k of n) as SQL, for k below n * p; 1 otherwise, where no bound can hold.

    Terms are summed downwards from k. They fall faster than a geometric series; the sum
    stops forty standard deviations below k, where nothing is left of them.
    """
    top = (f"exp({_ln_factorial(n)} - ({_ln_factorial(k)}) - ({_ln_factorial(f'({n} - {k})')}) "
           f"+ {k} * {math.log(p)!r} + ({n} - {k}) * {math.log1p(-p)!r})")
    steps = f"least({k}, CAST(40 * sqrt({n} * {p!r}) + 50 AS BIGINT))"
    ratio = f"({k} - i) * {1 - p!r} / (({n} - {k} + i + 1) * {p!r})"
    return f"""CASE WHEN {n} = 0 OR {k} >= {n} * {p!r} THEN 1D ELSE {top} * aggregate(
        sequence(0L, {steps}), struct(1D AS term, 0D AS total),
        (a, i) -> struct(a.term * {ratio} AS term, a.total + a.term AS total), a -> a.total) END"""


def select_cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
                   quality: str = "quality", risk: float = RISK,
                   error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff): at most one cutoff per stratum and rule."""
    known = (labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").alias("q"))
             .filter("doc_id IS NOT NULL AND q IS NOT NULL").groupBy("doc_id")
             .agg(F.min("q").alias("q"), F.max("q").alias("most")).filter("q = most").drop("most"))
    # The first step of the path that rejects a text, or the length of the path.
    firsts = [F.when(F.expr(f"{RULES[name][0]} > {RULES[name][1][j]!r}D"), t)
              for t, (name, j) in enumerate(PATH)]
    counts = (measured.filter(~_base_failed()).join(known, "doc_id")
              .select(_stratum().alias("stratum"), "q",
                      F.coalesce(*firsts, F.lit(len(PATH))).alias("first"))
              .groupBy("stratum", "first")
              .agg(F.sum(F.when(F.col("q") > 0, 1).otherwise(0)).alias("good"),
                   F.sum(F.when(F.col("q") > 0, 0).otherwise(1)).alias("bad")))
    rejected = lambda side: F.sum(F.when(F.col("first") <= F.col("step"), F.col(side))
                                  .otherwise(0))
    tried = (counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(PATH) - 1))).alias("step"))
             .groupBy("stratum", "step")
             .agg(rejected("good").alias("k"), rejected("bad").alias("caught"),
                  F.sum("good").alias("n")))
    tested = tried.withColumn("holds", F.expr(binomial_cdf("k", "n", risk)) <= error / len(BANDS))
    # Small from here on: at most one row per stratum and step.
    steps = F.sort_array(F.collect_list(F.struct("step", "holds", "k", "caught")))
    used = (tested.groupBy("stratum").agg(steps.alias("steps"))
            .select("stratum", F.expr("""
                slice(steps, 1, coalesce(nullif(array_position(transform(steps, s -> s.holds), false), 0),
                                         size(steps) + 1) - 1)""").alias("held"))
            .filter(F.size("held") > 0)
            .select("stratum", F.expr("""
                array_max(transform(held, s -> struct(s.caught - s.k AS gain, -s.step AS lenient)))
                """).alias("best"))
            .filter("best.gain > 0").select("stratum", (-F.col("best.lenient")).alias("last")))
    # A rule's cutoff is the strictest that the path has given it by then.
    path = F.array(*[F.struct(F.lit(t).alias("step"), F.lit(name).alias("rule"),
                              F.lit(RULES[name][1][j]).alias("cutoff"))
                     for t, (name, j) in enumerate(PATH)])
    return (used.select("stratum", "last", F.explode(path).alias("p")).filter("p.step <= last")
            .groupBy("stratum", "p.rule").agg(F.min("p.cutoff").alias("cutoff")))


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          risk: float = RISK, error: float = ERROR, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text: kept columns, its counts, `base_failed` and `kept`. The text is read once."""
    measured = materialize(measure(docs, doc_id, text, keep), "quality")
    cutoffs = select_cutoffs(measured, labels, risk=risk, error=error)
    by_band = (cutoffs.groupBy("stratum")
               .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")))
    over = F.lit(False)
    for name, (ratio, _) in RULES.items():
        over = over | F.coalesce(F.expr(ratio) > F.col("cuts")[name], F.lit(False))
    return (measured.withColumn("stratum", _stratum())
            .join(by_band, "stratum", "left")
            .withColumn("base_failed", _base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~over))
            .drop("stratum", "cuts", "n_capitals", "n_runs"))
