"""Language by the nearest of several centroids per language.

A text is a vector of character n-grams of one to three letters, hashed into a fixed number
of buckets, weighted by TF-IDF and brought to length one. Document frequencies cover all
training texts. Centroids come from spherical k-means over a bounded sample of training texts
per language. The language is that of the centroid with the largest cosine; a text farther
from it than nearly all of the centroid's own texts is marked as rejected.

Defined results: a null text or one without a letter is `und` with score 0 and is rejected;
ties go to the language first in alphabetical order; texts without a language are not learnt
from; no training text leaves every text `und`; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import sent

BUCKETS = 1 << 13
LONGEST = 3
CLUSTERS = 4
ROUNDS = 12
#: Training texts per language that k-means sees (expected number; texts are taken whole).
SAMPLE = 300
#: Share of a centroid's own texts that lie beyond its rejection distance.
BEYOND = 0.005
NONE = "und"


def letter_table() -> np.ndarray:
    """Per code point of the first plane: itself if it is a letter, else a space."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)], dtype=np.uint32)


def counts(texts: list[str | None], letters: np.ndarray) -> np.ndarray:
    """n-gram counts per text, one row each; a text without letters has a row of zeros."""
    lowered = [t.lower() if t else "" for t in texts]
    codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"),
                          dtype="<u4")
    high = codes > 0xFFFF
    known = letters[np.where(high, 32, codes)]
    if high.any():
        known[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    grams = []
    blank = known == 32
    mixed = known.astype(np.uint64)
    for n in range(1, LONGEST + 1):
        if n > 1:
            mixed = mixed[:-1] * np.uint64(1_000_003) + known[n - 1:]
            # A gram of two spaces or more at its start, or of a space alone, says nothing.
            blank = blank[:-1] & (known[n - 1:] == 32)
        value = (mixed ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 13)
        grams.append(np.where(blank, BUCKETS, value.astype(np.int64)))
    begin = 0
    for row, end in enumerate(ends.tolist()):
        for n, g in enumerate(grams):
            # The last place is the separator; grams that reach beyond it are left out.
            part = g[begin:max(begin, end - n)]
            out[row] += np.bincount(part, minlength=BUCKETS + 1)[:BUCKETS]
        begin = end
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def unit(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(rows) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun with points far from each other; no randomness."""
    middle = rows.mean(axis=0)
    chosen = [int(np.argmax(rows @ middle))]
    while len(chosen) < min(k, len(rows)):
        nearest = (rows @ rows[chosen].T).max(axis=1)
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-6:
            break
        chosen.append(far)
    centers = rows[chosen]
    for _ in range(ROUNDS):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else c
                         for i, c in enumerate(centers)])
        moved = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, centers):
            break
        centers = moved
    return centers


class Centroids:
    """What a prediction needs: buckets' weights, centroids, languages and distances."""

    def __init__(self, idf: np.ndarray, by_language: dict[str, np.ndarray], clusters: int):
        self.idf, self.letters = idf, letter_table()
        self.languages, centers, limits = [], [], []
        for language in sorted(by_language):
            rows = unit(by_language[language], idf)
            found = cluster(rows, clusters)
            near = rows @ found.T
            own = near.argmax(axis=1)
            for i, center in enumerate(found):
                mine = near[own == i, i]
                self.languages.append(language)
                centers.append(center)
                limits.append(np.quantile(mine, BEYOND) if len(mine) else 1.0)
        self.centers = np.array(centers, dtype=np.float32).reshape(-1, BUCKETS)
        self.limits = np.array(limits)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) per text."""
        if not self.languages:
            return [(NONE, 0.0, True)] * len(texts)
        cosines = unit(counts(texts, self.letters), self.idf) @ self.centers.T
        best = cosines.argmax(axis=1)
        top = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [(self.languages[b], float(c), bool(c < self.limits[b])) if has_letter(t)
                else (NONE, 0.0, True) for t, b, c in zip(texts, best.tolist(), top)]


def _statistics(train: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Document frequency per bucket over all training texts, and texts per language. Tasks
    add up before the shuffle; the driver gets one row per bucket and language."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, langs = letter_table(), np.zeros(BUCKETS, dtype=np.int64), {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                df += (counts(texts[at:at + 100], letters) > 0).sum(axis=0)
            for name in names:
                langs[name] = langs.get(name, 0) + 1
        keys = [str(i) for i in range(BUCKETS)] if langs else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(["df"] * len(keys) + ["lang"] * len(langs), pa.string()),
             pa.array(keys + list(langs), pa.string()),
             pa.array(df.tolist()[:len(keys)] + list(langs.values()), pa.int64())],
            names=["what", "k", "n"])

    rows = (train.select("text", "lang").mapInArrow(work, "what string, k string, n long")
            .groupBy("what", "k").agg(F.sum("n").alias("n")).collect())
    df, langs = np.zeros(BUCKETS), {}
    for what, key, n in rows:
        if what == "df":
            df[int(key)] = n
        else:
            langs[key] = n
    return df, langs


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang",
        sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids:
    """Learn from the rows where `learn` holds and the language is known."""
    train = (docs.filter(learn).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
             .filter("lang IS NOT NULL AND text IS NOT NULL"))
    df, langs = _statistics(train)
    n = sum(langs.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    by_language: dict[str, list[np.ndarray]] = {}
    if langs:
        # A share per language that is expected to give `sample` rows. Copies are told apart
        # by a row number, so that a text with many copies is not taken with all of them.
        share = F.create_map(*[F.lit(x) for k, v in langs.items() for x in (k, min(1.0, sample / v))])
        place = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30))
        picked = train.withColumn("place", place).filter(
            F.col("place") < share[F.col("lang")] * (1 << 30)).select("text", "lang")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            letters = letter_table()
            for batch in batches:
                for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    row = counts([t], letters)[0]
                    if row.any():
                        at = np.nonzero(row)[0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name], pa.string()), pa.array([at.tolist()], pa.list_(pa.int32())),
                             pa.array([row[at].tolist()], pa.list_(pa.float32()))],
                            names=["lang", "at", "n"])

        rows = picked.mapInArrow(work, "lang string, at array<int>, n array<float>")
        for row in rows.collect():
            dense = np.zeros(BUCKETS, dtype=np.float32)
            dense[row["at"]] = row["n"]
            by_language.setdefault(row["lang"], []).append(dense)
    return Centroids(idf, {k: np.array(v) for k, v in by_language.items()}, clusters)


def predict(docs: DataFrame, model: Centroids, text: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, lang_pred, score (cosine, 0 to 1) and rejected, for every row."""
    n = len(keep)
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    shared = sent(docs.sparkSession, model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            texts = batch.column(n).to_pylist()
            found = [p for at in range(0, len(texts), 100)
                     for p in own.predict(texts[at:at + 100])]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(n)], pa.array(columns[0], pa.string()),
                 pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=[*keep, "lang_pred", "score", "rejected"])

    return (docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`"))
            .mapInArrow(work, f"{fields}, lang_pred string, score double, rejected boolean"))
