"""Log-likelihood of whole texts under a gated recurrent model with a class-factored output.

P(word | text before) = P(class | state) * P(word | class). The recurrent model (`gru.py`)
gives the first; counts of all training tokens give the second, with the same additive
smoothing as the base model. The most frequent words are classes of their own, other words
are classed by their last two bytes, and the end of a text is a class.

Counts cover every training text. The recurrent weights are learnt where the texts are: each
task trains on its texts, and the weights of all tasks are averaged by tokens. The training
texts are dealt out to a few rounds, and every one is trained on in one of them. Only weights
reach the driver.

The most frequent words (a fixed number) travel to the tasks with their counts. For all other
words each text meets their counts in one join, so no vocabulary is held in memory.

Defined results: a null text is the empty text, whose one token is its end; an unseen word
has count zero in its class; repeated rows are scored each; without training texts the base
score is that of the formula with no counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import gru
from attesta.llm.common import lower_words_of, sent, settle

ALPHA = 0.1
#: Words that are classes of their own; classes by ending.
WORDS = 47
ENDINGS = 48
CLASSES = WORDS + ENDINGS + 1
END = CLASSES - 1
#: Words whose counts travel to the tasks.
FREQUENT = 200_000
#: Rounds of training, each over another part of the training texts; all parts are used.
ROUNDS = 2
#: Tokens trained together and scored together in a task.
TRAINED = 1 << 20
TOGETHER = 1 << 22
#: Distinct words counted before a task hands them on.
COUNTED = 250_000


def ending_class(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-2:]) % ENDINGS


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts; tasks add up before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(lower_words_of(value.as_py()))
                if len(seen) >= COUNTED:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    return (train.select("text").mapInArrow(work, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("c")))


class Vocabulary:
    """Frequent words with counts, and the totals of every class."""

    def __init__(self, frequent: list[tuple[bytes, int]], totals: list[tuple[int, int, int]],
                 n_texts: int):
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        #: Classes of the endings met so far.
        self.endings: dict[bytes, int] = {}
        self.log_c = np.array([math.log10(c + ALPHA) for _, c in frequent] or [0.0])
        self.class_of = np.array(
            [i if i < WORDS else ending_class(w) for i, (w, _) in enumerate(frequent)] or [0],
            dtype=np.int16)
        tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, c, v in totals:
            tokens[k], types[k] = c, v
        for i, (w, c) in enumerate(frequent[:WORDS]):
            # Totals are by ending. A word of its own class leaves the class of its ending.
            tokens[ending_class(w)] -= c
            types[ending_class(w)] -= 1
            tokens[i], types[i] = c, 1
        if n_texts:
            tokens[END], types[END] = n_texts, 1
        self.tokens = tokens
        self.n, self.v = int(tokens.sum()), int(types.sum())
        self.end_log_c = math.log10(n_texts + ALPHA)
        self.end_known = int(n_texts > 0)
        self.log_class = np.log10(tokens + ALPHA * (types + 1))

    def read(self, text: str | None) -> tuple[np.ndarray, int, float, Counter]:
        """Classes of the tokens, known frequent tokens, the sum of their log10(c + 0.1), and
        the other words."""
        words = lower_words_of(text)
        ids = np.array([self.index.get(w, -1) for w in words], dtype=np.int32)
        classes = np.empty(len(words) + 1, dtype=np.int16)
        classes[:-1] = self.class_of[ids]
        classes[-1] = END
        other = np.nonzero(ids < 0)[0].tolist()
        rest = [words[i] for i in other]
        if rest:
            endings = [w[-2:] for w in rest]
            for ending in set(endings).difference(self.endings):
                self.endings[ending] = ending_class(ending)
            classes[other] = list(map(self.endings.__getitem__, endings))
        known = ids[ids >= 0]
        return (classes, len(known) + self.end_known,
                float(self.log_c[known].sum()) + self.end_log_c, Counter(rest))


def build_vocabulary(counts: DataFrame, n_texts: int, frequent: int = FREQUENT) -> Vocabulary:
    """The driver gets `frequent` words at most, and one row per class and step of counts."""
    # Counts in steps of an eighth of a power of two: the lowest step down to which all words
    # together are few enough. So no task sends words that are not wanted.
    step = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()
    least, room = math.inf, frequent
    for s, n in sorted(map(tuple, sizes), reverse=True):
        if n > room:
            break
        least, room = s, room - n
    top = sorted(((bytes(r["word"]), r["c"]) for r in counts.filter(step >= least).collect()),
                 key=lambda x: (-x[1], x[0])) if sizes and least < math.inf else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            k = np.array([ending_class(w) for w in batch.column(0).to_pylist()], dtype=np.int64)
            tokens += np.bincount(k, weights=batch.column(1).to_numpy(zero_copy_only=False),
                                  minlength=CLASSES).astype(np.int64)
            types += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(tokens), pa.array(types)],
            names=["k", "c", "v"])

    totals = (counts.select("word", "c").mapInArrow(work, "k long, c long, v long")
              .groupBy("k").agg(F.sum("c"), F.sum("v")).collect())
    return Vocabulary(top, [tuple(r) for r in totals], n_texts)


def part_of(text: Column, rounds: int = ROUNDS) -> Column:
    """The round that trains on a text."""
    return F.pmod(F.xxhash64(text), F.lit(rounds)).cast("int")


def fit(texts: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights averaged over all tasks, round by round, from (part, classes): the round of each
    text and the class of each of its tokens, a byte each."""
    spark = texts.sparkSession
    params = gru.init(CLASSES, classes)
    shapes = [p.shape for p in params]
    for r in range(rounds):
        before = spark.sparkContext.broadcast(params)

        def work(batches: Iterator[pa.RecordBatch], before=before) -> Iterator[pa.RecordBatch]:
            trainer, read, size = gru.Trainer(before.value), [], 0
            for batch in batches:
                for value in batch.column(0):
                    read.append(np.frombuffer(value.as_py(), dtype=np.uint8))
                    size += len(read[-1])
                    if size >= TRAINED:
                        trainer.train(read)
                        read, size = [], 0
            if read:
                trainer.train(read)
            if trainer.tokens:
                flat = np.concatenate([p.ravel() for p in trainer.params]).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat))), pa.array(flat * trainer.tokens),
                     pa.array(np.full(len(flat), trainer.tokens, dtype=np.int64))],
                    names=["i", "x", "n"])

        # As many rows as there are weights, whatever the input.
        mean = (texts.filter(F.col("part") == r).select("classes")
                .mapInArrow(work, "i long, x double, n long").groupBy("i")
                .agg((F.sum("x") / F.sum("n")).alias("x")).collect())
        if mean:
            flat = np.zeros(sum(math.prod(s) for s in shapes))
            for i, x in mean:
                flat[i] = x
            cuts = np.cumsum([math.prod(s) for s in shapes])[:-1]
            params = [p.reshape(s).astype(np.float32)
                      for p, s in zip(np.split(flat, cuts), shapes)]
    return params


def train(rows: DataFrame, vocabulary: Callable[[], Vocabulary] | Broadcast, classes: np.ndarray,
          rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights from the column `text`. Each text is in one round's part.

    `vocabulary`: what `sent` gives, or a plain broadcast where workers can import this package."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary() if callable(vocabulary) else vocabulary.value
        for batch in batches:
            read = [own.read(v.as_py())[0].astype(np.uint8).tobytes() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, pa.binary())],
                                             names=["part", "classes"])

    return fit(rows.select(part_of(F.col("text"), rounds).alias("part"), "text")
               .mapInArrow(work, "part int, classes binary"), classes, rounds)


def read_texts(rows: DataFrame, vocabulary: Callable[[], Vocabulary], kind: str) -> DataFrame:
    """One row per row, with all that training and scoring need: the classes of the tokens, a
    byte each, what the vocabulary knows of them, and the counts of the other words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary()
        for batch in batches:
            read = [own.read(value.as_py()) for value in batch.column(3)]
            rare = [r[3] for r in read]
            offsets = np.cumsum([0, *map(len, rare)])
            words = pa.StructArray.from_arrays(
                [pa.array([w for c in rare for w in c], pa.binary()),
                 pa.array([n for c in rare for n in c.values()], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(r[0]) for r in read], pa.int64()),
                 pa.array([r[1] for r in read], pa.int64()),
                 pa.array([r[2] for r in read], pa.float64()),
                 pa.array([r[0].astype(np.uint8).tobytes() for r in read], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)],
                names=["doc_id", "held_out", "part", "n_tokens", "n_known", "log_c", "classes",
                       "rare"])

    return (rows.select("doc_id", "held_out", part_of(F.col("text")).alias("part"), "text")
            .mapInArrow(work, f"doc_id {kind}, held_out boolean, part int, n_tokens long, "
                              "n_known long, log_c double, classes binary, "
                              "rare array<struct<word:binary,n:long>>")
            .withColumn("row", F.monotonically_increasing_id()))


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where `held_out` is false. Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out.alias("held_out"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = rows.filter(~F.col("held_out"))
    counts = settle(count_words(known), "lm-counts")
    words = build_vocabulary(counts, known.count())
    kind = docs.schema[doc_id].dataType.simpleString()
    read = settle(read_texts(rows, sent(spark, words), kind), "lm-read")
    params = spark.sparkContext.broadcast(
        fit(read.filter(~F.col("held_out")).select("part", "classes"), words.tokens))
    log_class = words.log_class

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[pa.Array], classes: list[np.ndarray]) -> pa.RecordBatch:
            within = gru.log_likelihoods(params.value, classes) / math.log(10)
            within -= np.array([log_class[c].sum() for c in classes])
            return pa.RecordBatch.from_arrays([pa.concat_arrays(rows), pa.array(within)],
                                              names=["row", "within"])

        rows, classes, size = [], [], 0
        for batch in batches:
            rows.append(batch.column(0))
            for value in batch.column(1):
                classes.append(np.frombuffer(value.as_py(), dtype=np.uint8))
                size += len(classes[-1])
            if size >= TOGETHER:
                yield out(rows, classes)
                rows, classes, size = [], [], 0
        if classes:
            yield out(rows, classes)

    within = settle(read.select("row", "classes").mapInArrow(work, "row long, within double"),
                    "lm-scored")
    rare = (read.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
            .join(counts, "word", "left")
            .groupBy("row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
                F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA)))
                .alias("more_log_c")))
    n, v = words.n, words.v
    log_c = F.col("log_c") + F.coalesce("more_log_c", F.lit(0.0))
    scored = read.select("row", "doc_id", "held_out", "n_tokens", "n_known", "log_c")
    return scored.join(within, "row").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (log_c - F.col("n_tokens") * math.log10(n + ALPHA * (v + 1))).alias("base_score"),
        (log_c + F.col("within")).alias("score"))
