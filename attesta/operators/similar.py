"""The k most similar texts by shared trigrams: exact, without a pair of texts in a shuffle.

Inside a block pair the right side is an inverted index (trigram to texts, texts sorted by the size
of their sets). A query adds up the postings of its trigrams, which gives the overlap with every
text it shares anything with. Thresholds fall: sizes bound the similarity, so at 0.7 only texts
between 0.7 and 1/0.7 times the query's size are looked at, and a query with k answers at or above
the threshold is settled; only the others go on to the next one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as X
from attesta.operators import grid

#: Thresholds tried before the one asked for.
FALLING = (0.7, 0.5, 0.35)


class GramIndex:
    """Texts of a block by trigram. Rows are numbered in the order of their sets' sizes."""

    def __init__(self, grams: pa.ListArray):
        sizes = grams.value_lengths().to_numpy()
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        rank = np.empty_like(self.order)
        rank[self.order] = np.arange(len(rank))
        coded = grams.flatten().dictionary_encode()
        self.known = coded.dictionary
        codes = coded.indices.to_numpy().astype(np.int64)
        # Postings sorted by (trigram, row): one number holds both.
        self.keys = np.sort(codes * len(sizes) + np.repeat(rank, sizes))

    def codes(self, grams: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the trigrams of all queries, -1 where no text has one, and query bounds."""
        found = pc.index_in(grams.flatten(), self.known).fill_null(-1).to_numpy()
        return found.astype(np.int64), np.concatenate([[0], np.cumsum(
            grams.value_lengths().to_numpy())])

    def overlaps(self, codes: np.ndarray, first: int, last: int) -> np.ndarray:
        """Trigrams shared with each of the rows from `first` up to `last`."""
        n = len(self.sizes)
        begin = np.searchsorted(self.keys, codes * n + first)
        end = np.searchsorted(self.keys, codes * n + last)
        many = end - begin
        places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.keys[places] % n - first, minlength=last - first)

    def best(self, codes: np.ndarray, size: int, threshold: float,
             enough) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores above the threshold, or all at or above an earlier one with which
        `enough(rows)` is content."""
        known = codes[codes >= 0]
        for t in (*(t for t in FALLING if t > threshold), threshold):
            # Widened against rounding; the scores below decide.
            first = np.searchsorted(self.sizes, t * size - 1e-6)
            last = np.searchsorted(self.sizes, size / t + 1e-6) if t > 0 else len(self.sizes)
            shared = self.overlaps(known, first, last)
            score = shared / (size + self.sizes[first:last] - shared)
            hit = np.flatnonzero(score >= t if t > threshold else score > threshold)
            rows = self.order[first + hit]
            if t == threshold or enough(rows):
                return rows, score[hit]
        raise AssertionError("the last threshold returns")


def _distinct(texts: DataFrame, *more: str) -> DataFrame:
    """Distinct texts with a 16-byte id and their trigrams; texts without any are left out."""
    return (texts.select(F.unhex(F.md5("text")).alias("id"), *more,
                         X.trigrams(F.col("text")).alias("grams"))
            .filter(F.size("grams") > 0))


def most_similar(queries: DataFrame, entries: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k best keys per distinct query text: (text, key, score, place).

    `queries` has text; `entries` has key and text, a key any number of texts: its most similar
    one counts. Scores above the threshold only; higher scores first, ties by key. Null texts and
    texts without words match nothing. Of the keys of one text only the first k can matter; they
    are picked before anything is gathered.
    """
    asked = queries.select("text").filter(F.col("text").isNotNull()).distinct()
    place = F.row_number().over(Window.partitionBy("text").orderBy("key"))
    owned = (entries.select("text", "key").filter(F.col("text").isNotNull()).distinct()
             .withColumn("_n", place).filter(F.col("_n") <= k)
             .groupBy("text").agg(F.sort_array(F.collect_list("key")).alias("keys")))

    def kernel(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        index = GramIndex(right.column("grams").combine_chunks())
        keys = right.column("keys").to_pylist()
        codes, bounds = index.codes(left.column("grams").combine_chunks())

        def enough(rows: np.ndarray) -> bool:
            return len({key for r in rows.tolist() for key in keys[r]}) >= k

        ids, found, scores = [], [], []
        for q, name in enumerate(left.column("id").to_pylist()):
            mine = codes[bounds[q]:bounds[q + 1]]
            rows, score = index.best(mine, len(mine), threshold, enough)
            top: dict[str, float] = {}
            for s, r in sorted(zip(score.tolist(), rows.tolist()), key=lambda x: -x[0]):
                if len(top) >= k and s < min(top.values()):
                    break
                for key in keys[r]:
                    top.setdefault(key, s)
            kept = sorted(top.items(), key=lambda x: (-x[1], x[0]))[:k]
            ids += [name] * len(kept)
            found += [key for key, _ in kept]
            scores += [s for _, s in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(found, pa.string()),
             pa.array(scores, pa.float64())], names=["id", "key", "score"])

    met = grid.meet(_distinct(asked), _distinct(owned, "keys"), kernel,
                    "id binary, key string, score double")
    best = met.groupBy("id", "key").agg(F.max("score").alias("score"))
    ranked = best.withColumn("place", F.row_number().over(
        Window.partitionBy("id").orderBy(F.desc("score"), "key"))).filter(F.col("place") <= k)
    return (asked.select("text", F.unhex(F.md5("text")).alias("id")).join(ranked, "id")
            .select("text", "key", "score", "place"))
