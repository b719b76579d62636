"""Benchmark decontamination: a BM25 index of test items, searched by every passage.

The test items are the indexed documents, the passages of the training texts are the queries.
Weights are divided by what an item would score for itself, so a score is the share of an
item's BM25 mass that a passage holds and one threshold serves items of any length. Postings
are kept in blocks of items with the largest weight of each block: a passage looks only into
blocks whose bounds add up to the threshold, and there moves from pivot to pivot (WAND). What
reaches the threshold is verified by five-word overlap with the item's question and answer.

Items are indexed in shards of bounded text; each shard is sent to the tasks as one value of
known size and searched by one scan of the texts. Nothing is shuffled but item statistics.

Defined results: null texts and texts without words match nothing, and neither do items
without words; repeated items are reported each, repeated rows too; items longer than a part
are indexed in parts and verified whole; passages overlap by half and are longer than two
parts, so no part falls between them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import sent

K1, B = 1.2, 0.75
#: Share of an item's BM25 mass that a passage must hold, and the overlap that verifies it.
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
PART_WORDS = 64
STEP_WORDS = 80
BLOCK_ITEMS = 8
#: Item text per shard, in bytes.
SHARD_BYTES = 512 << 10

TERM = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's answer is its last sentence; a single sentence is cut in the middle."""
    parts = [t for t in map(terms_of, SENTENCE.split(text)) if t]
    if not parts:
        return [], []
    if len(parts) == 1:
        half = (len(parts[0]) + 1) // 2
        return parts[0][:half], parts[0][half:]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) <= SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


class Index:
    """One shard: blocks of postings with their bounds, and the items' shingles."""

    def __init__(self, items: list[tuple], df: dict[str, int], n_items: int, mean_words: float):
        self.ids, self.words, self.asked, self.answered = [], [], [], []
        self.part_item, parts = [], []
        for item_id, text in items:
            words = terms_of(text)
            if not words:
                continue
            question, answer = question_and_answer(text)
            for at in range(0, len(words), PART_WORDS):
                self.part_item.append(len(self.ids))
                parts.append(words[at:at + PART_WORDS])
            self.ids.append(item_id)
            self.words.append(words)
            self.asked.append(shingles(question))
            self.answered.append(shingles(answer))
        self.whole = [shingles(w) for w in self.words]
        self.blocks = (len(parts) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        self.term: dict[str, int] = {}
        #: Postings by (term, block): parts in order, and their weights.
        self.postings: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
        for p, words in enumerate(parts):
            weights = {}
            for w in words:
                weights[w] = weights.get(w, 0) + 1
            fit = K1 * (1 - B + B * len(words) / mean_words)
            for w, tf in weights.items():
                idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + fit)
            own = sum(weights.values())
            for w, x in weights.items():
                t = self.term.setdefault(w, len(self.term) + 1)
                self.postings[t, p // BLOCK_ITEMS].append((p, x / own))
        # Row 0 stands for words that no item has.
        self.bound = np.zeros((len(self.term) + 1, self.blocks), dtype=np.float32)
        for (t, b), rows in self.postings.items():
            self.bound[t, b] = max(x for _, x in rows)
        self.postings = dict(self.postings)
        self.best = self.bound.max(axis=1, initial=0)

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(part, score) of all parts that a passage's distinct terms reach the threshold for."""
        bounds = self.bound[terms]
        found = []
        for block in np.nonzero(bounds.sum(axis=0) >= threshold - 1e-4)[0].tolist():
            found += self._wand(terms[bounds[:, block] > 0].tolist(), block, threshold)
        return found

    def _wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        cursors = [[self.postings[t, block], 0, float(self.bound[t, block])] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            reach, pivot = 0.0, None
            for rows, at, most in cursors:
                reach += most
                if reach >= threshold - 1e-4:
                    pivot = rows[at][0]
                    break
            if pivot is None:
                break
            if cursors[0][0][cursors[0][1]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[1]][0] != pivot:
                        break
                    score += c[0][c[1]][1]
                    c[1] += 1
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
            else:
                for c in cursors:
                    if c[0][c[1]][0] >= pivot:
                        break
                    while c[1] < len(c[0]) and c[0][c[1]][0] < pivot:
                        c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def matches(self, text: str | None, threshold: float,
                overlap: float) -> list[tuple[object, float, float, float]]:
        """(item, score, question overlap, answer overlap) of the items found in a text."""
        words = terms_of(text)
        if not words or not self.ids:
            return []
        ids = np.fromiter(map(self.term.get, words, repeat(0)), dtype=np.int64, count=len(words))
        total = np.concatenate([[0.0], np.cumsum(self.best[ids], dtype=np.float64)])
        starts = np.arange(0, max(1, len(words) - STEP_WORDS), STEP_WORDS)
        ends = np.minimum(starts + 2 * STEP_WORDS, len(words))
        best: dict[int, tuple[float, float, float]] = {}
        for i in np.nonzero(total[ends] - total[starts] >= threshold - 1e-4)[0].tolist():
            a, b = int(starts[i]), int(ends[i])
            terms = np.unique(ids[a:b])
            terms = terms[terms > 0]
            if self.best[terms].sum() < threshold - 1e-4:
                continue
            for part, score in self.search(terms, threshold):
                item = self.part_item[part]
                size = len(self.words[item])
                near = shingles(words[max(0, a - size):b + size])
                if not self.whole[item] - near:
                    asked = answered = 1.0
                else:
                    asked = _share(self.asked[item], near, words, a, b, size)
                    answered = _share(self.answered[item], near, words, a, b, size)
                    together = len(self.whole[item] & near) / len(self.whole[item])
                    if together < overlap and min(asked, answered) < overlap:
                        continue
                if item not in best or best[item][0] < score:
                    best[item] = (score, asked, answered)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def _share(wanted: set, near: set, words: list[str], a: int, b: int, size: int) -> float:
    """Share of the wanted shingles that are near. One shorter than five words is looked for
    as a run of words."""
    if not wanted:
        return 1.0
    if len(wanted) == 1 and len(run := next(iter(wanted))) < SHINGLE:
        here = words[max(0, a - size):b + size]
        return float(any(tuple(here[i:i + len(run)]) == run for i in range(len(here))))
    return len(wanted & near) / len(wanted)


def build_shards(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list[Index]:
    """Index shards. Statistics cover all items; a shard's items (`SHARD_BYTES` of text on
    average, whole items only) are what the driver holds at a time."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The index is made of the same terms as the queries: they are cut by one Python rule.
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    words = rows.select("text").mapInArrow(cut, "terms array<string>").filter("size(terms) > 0")
    n_items, n_words, n_bytes = words.agg(
        F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0)),
        F.coalesce(F.sum(F.length(F.array_join("terms", " "))), F.lit(0))).first()
    if not n_items:
        return []
    df = words.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count()
    n_shards = max(1, math.ceil(n_bytes / SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    shards = []
    for s in range(n_shards):
        own = [tuple(r) for r in rows.filter(F.col("shard") == s).select("item_id", "text")
               .orderBy("item_id", "text").collect()]
        known = sorted({w for _, t in own for w in terms_of(t)})
        if not known:
            continue
        wanted = items.sparkSession.createDataFrame([(w,) for w in known], "t string")
        counts = {r["t"]: r["count"] for r in df.join(wanted, "t").collect()}
        shards.append(Index(own, counts, n_items, min(PART_WORDS, n_words / n_items)))
    return shards


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
               overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row per item found in a
    text; the score is that of its best passage."""
    id_kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = items.schema[item_id].dataType.simpleString()
    schema = (f"doc_id {id_kind}, item_id {item_kind}, score double, question_overlap double, "
              "answer_overlap double")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = None
    for index in build_shards(items, item_id, item_text):
        shared = sent(docs.sparkSession, index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared()
            for batch in batches:
                which, hits = [], []
                for i, t in enumerate(batch.column(1)):
                    for hit in own.matches(t.as_py(), threshold, overlap):
                        which.append(i)
                        hits.append(hit)
                columns = list(zip(*hits)) if hits else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(which, pa.int64())),
                     pa.array(columns[0], type=_arrow(item_kind)),
                     *[pa.array(c, type=pa.float64()) for c in columns[1:]]],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(work, schema)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
