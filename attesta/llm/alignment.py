"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same text, and how often.

Both tokenizers cut the same bytes. Places where both end a token cut a text into groups; two
tokens whose byte ranges overlap are linked. The weight of a pair of ids is the number of
documents that hold it linked.

Fast path: `identity[a]` is the id of the second tokenizer with the bytes of `a`, worked out once
from the two vocabularies. A group of one token on each side is such a pair, so these are counted
in one vector as long as the vocabulary. Only the pairs of irregular groups enter the shuffle of
pairs, counted per task first. (A pair of `identity` that an irregular group holds as well belongs
to the same vector, as a document counts once.)

Jobs: (1) encode, and write per text its counts and its distinct pairs with their links;
(2) count documents per pair; (3) give every text the weights of its pairs. The vector of
identities, the highest weight per id and the most frequent pairs (at most `FREQUENT`, a bound on
what is sent, not on what is counted) travel with the task code; all other pairs meet their
weights in a join on the pair.

Defined results: a text that is null, empty, or that either tokenizer does not give back byte for
byte has no tokens: zeros and an empty digest. Repeated rows count once each; a null id is kept.
Texts are whole and one text is one task's work, in memory proportional to it. Runs jobs while the
frame is built.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import aside, settle
from attesta.llm.pieces import SPACE

#: Bytes of text that are encoded and linked in one go; a longer text goes by itself.
CHUNK_BYTES = 1 << 20
#: Pairs counted in a task before they are handed to Spark.
HELD_PAIRS = 1 << 21
#: Most pairs whose weights travel with the task code (12 bytes each).
FREQUENT = 1 << 18


def byte_level_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: visible bytes as
    themselves, all others as the letters from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer file; strings of special tokens inside texts are plain text.

    Where the file's merges stand in the order of their ids, as they do in files made by counting,
    the rank form of the same vocabulary gives the same ids in a third of the time. It is used for
    texts of characters whose classes all Unicode versions agree on and without very long words
    (its time grows with the square of a word); all other texts go through the file's own form.
    """

    PLAIN = re.compile("[\u0000-\u036f\u2000-\u206f]*")
    LONG = re.compile(r"\s{400}")
    LONGEST = 400

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True
        letter = byte_level_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        told = json.loads(data)
        special = {t["id"] for t in told.get("added_tokens", [])}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes[i] = bytes(letter[c] for c in token)
        self.ranked = self._ranked(told, vocabulary, special)

    def _ranked(self, told: dict, vocabulary: dict[str, int], special: set[int]):
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [vocabulary.get("".join(m)) for m in merges]
        cut = told.get("pre_tokenizer") or {}
        known = {i: x for i, x in enumerate(self.bytes) if i not in special and x}
        if (made != list(range(256, 256 + len(made))) or len(known) != 256 + len(made)
                or told.get("normalizer") or cut.get("type") != "ByteLevel"
                or cut.get("add_prefix_space") or not cut.get("use_regex", True)):
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={x: i for i, x in known.items()})

    def _plain(self, text: str) -> bool:
        return (self.ranked is not None and self.PLAIN.fullmatch(text) is not None
                and not self.LONG.search(text)
                and max(map(len, text.split()), default=0) < self.LONGEST)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.ranked.encode_ordinary(" " + t) if self._plain(t) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.tokenizer.encode_batch([" " + texts[k] for k in rest],
                                                          add_special_tokens=False)):
            out[k] = e.ids
        return out


class Pieces:
    """A SentencePiece model file that puts a space in front by itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i)
                      else b"" if m.is_control(i)
                      else m.id_to_piece(i).replace(SPACE, " ").encode()
                      for i in range(m.get_piece_size())]
        self.plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))
                      for i in range(m.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def identity_map(a: ByteLevel, b: Pieces) -> np.ndarray:
    """Per id of `a` the id of `b` with the same bytes, -1 if none; whole pieces before bytes."""
    same: dict[bytes, int] = {}
    for i in sorted(range(len(b.bytes)), key=lambda i: (b.plain[i], -i)):
        if b.bytes[i]:
            same[b.bytes[i]] = i
    return np.array([same.get(x, -1) if x else -1 for x in a.bytes], dtype=np.int64)


class Aligner:
    """Both tokenizers of a task, with the sizes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        self.marked = [f"{i}{mark}" for t, marks in ((self.a, ",|"), (self.b, ",;"))
                       for i in range(len(t.bytes)) for mark in marks]
        self.identity = identity_map(self.a, self.b)
        self.width = len(self.b.bytes)

    def whole(self, texts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Texts that both tokenizers give back, by number, and their ids."""
        kept, in_a, in_b = [], [], []
        for k, (t, x, y) in enumerate(zip(texts, self.a.encode(texts), self.b.encode(texts))):
            want = b" " + t.encode()
            if (b"".join(map(self.a.bytes.__getitem__, x)) == want
                    and b"".join(map(self.b.bytes.__getitem__, y)) == want):
                kept.append(k)
                in_a.append(x)
                in_b.append(y)
        return kept, in_a, in_b

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """Per text (n_a, n_b, n_groups, n_links, groups_sha256, pairs, links per pair)."""
        kept, in_a, in_b = self.whole(texts)
        found = dict.fromkeys(range(len(texts)))
        if kept:
            # Texts end both tokenizers' tokens, so a chunk of texts is one sequence of bytes.
            a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (in_a, in_b))
            ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
            last_a, last_b = (np.cumsum([len(x) for x in ids]) for ids in (in_a, in_b))
            last_in_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
            last_in_b = np.zeros(len(b), dtype=bool)
            last_in_b[np.searchsorted(ends_b, ends_a[last_in_a])] = True
            # One link for each stretch between neighbouring ends of either side.
            links = np.concatenate([ends_a, ends_b[~last_in_b]])
            links.sort(kind="stable")
            la, lb = np.searchsorted(ends_a, links), np.searchsorted(ends_b, links)
            space = self.width * len(self.sizes[0])
            pairs, times = _summed([np.searchsorted(last_a, la, side="right") * space
                                    + a[la] * self.width + b[lb]])
            bounds = np.searchsorted(pairs, np.arange(len(kept) + 1) * space)
            pairs %= space
            # The groups written out: a group's tokens of `a`, then those of `b`, each with the
            # mark that follows it.
            group_a, group_b = (np.cumsum(x) - x for x in (last_in_a, last_in_b))
            many_a, many_b = np.bincount(group_a), np.bincount(group_b)
            shown = np.empty(len(a) + len(b), dtype=np.int64)
            shown[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = 2 * a + last_in_a
            shown[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = (
                2 * len(self.sizes[0]) + 2 * b + last_in_b)
            written = list(map(self.marked.__getitem__, shown.tolist()))
            groups, ends = np.cumsum(last_in_a)[last_a - 1], last_a + last_b
            for j, k in enumerate(kept):
                mine = slice(bounds[j], bounds[j + 1])
                text = "".join(written[ends[j - 1] if j else 0:ends[j]])[:-1]
                found[k] = (len(in_a[j]), len(in_b[j]), int(groups[j] - (groups[j - 1] if j else 0)),
                            int(times[mine].sum()), hashlib.sha256(text.encode()).hexdigest(),
                            pairs[mine], times[mine])
        none = np.zeros(0, dtype=np.int64)
        for k in range(len(texts)):
            yield found[k] or (0, 0, 0, 0, "", none, none)


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each stands there."""
    return np.unique(np.concatenate(held), return_counts=True)


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
COUNT_TYPES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _encoded(docs: DataFrame, row: str, a: bytes, b: bytes, keep: tuple[str, ...],
             text: str) -> DataFrame:
    """Per row a number of its own, the kept columns, its counts, and its distinct pairs as sorted
    numbers with the links of each."""
    kept, plain, types, _ = aside(docs, keep)
    n = len(keep) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a, b)

        def done(rows: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
            out = list(zip(*aligner.align(texts)))
            pairs, times = out[5], out[6]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind)))
                     for x, kind in ((pairs, np.int64), (times, np.int32))]
            return pa.RecordBatch.from_arrays(
                [*rows.columns[:n], *(pa.array(x, pa.int64()) for x in out[:4]),
                 pa.array(out[4], pa.string()), *lists],
                names=[row, *plain, *COUNTS, "pairs", "times"])

        for batch in batches:
            begin, texts, held = 0, [], 0
            for k, value in enumerate(batch.column(n), 1):
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK_BYTES or k == batch.num_rows:
                    yield done(batch.slice(begin, k - begin), texts)
                    begin, texts, held = k, [], 0

    return (docs.select(F.monotonically_increasing_id().alias(row), *kept,
                        F.col(f"`{text}`").alias("text"))
            .mapInArrow(work, f"{row} long, {types}{COUNT_TYPES}, "
                              "pairs array<long>, times array<int>"))


def _counted(encoded: DataFrame, identity: np.ndarray, width: int) -> DataFrame:
    """(pair, exact, n): documents that hold a pair. The pairs of `identity` are summed in a vector, the
    others in a table of bounded size; both leave the task as counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(identity), dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs), pa.array(n), pa.array(identity[pairs // width] == pairs % width)],
                names=["pair", "n", "exact"])

        for batch in batches:
            pairs = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            a, b = np.divmod(pairs, width)
            exact = identity[a] == b
            vector += np.bincount(a[exact], minlength=len(vector))
            held.append(pairs[~exact])
            size += len(held[-1])
            if size >= HELD_PAIRS:
                yield rows(*_summed(held))
                held, size = [], 0
        if size:
            yield rows(*_summed(held))
        a = np.flatnonzero(vector)
        if len(a):
            yield rows(a * width + identity[a], vector[a])

    counted = encoded.select("pairs").mapInArrow(work, "pair long, n long, exact boolean")
    return counted.groupBy("pair", "exact").agg(F.sum("n").alias("n"))


def _numbers(df: DataFrame) -> list[np.ndarray]:
    """Columns of whole numbers of a frame of bounded length."""
    return [c.to_numpy() if len(c) else np.zeros(0, dtype=np.int64) for c in df.toArrow().columns]


def _frequent_floor(counts: DataFrame, frequent: int) -> int:
    """The least power of two that at most `frequent` pairs reach."""
    sizes = {r[0]: r[1] for r in
             counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*")).collect()}
    total, floor = 0, max(sizes, default=0) + 1
    while floor > 0 and total + sizes.get(floor - 1, 0) <= frequent:
        floor -= 1
        total += sizes.get(floor, 0)
    return 1 << floor


def align(docs: DataFrame, a: bytes, b: bytes, text: str = "text",
          keep: tuple[str, ...] = ("doc_id",), frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: the kept columns, counts of tokens, groups and links, `n_best`
    (links whose pair no other pair of the same first id outweighs), `count_sum` (weights summed
    over links) and the digest of the groups.

    `a` is a byte-level tokenizer file, `b` a SentencePiece model file, as bytes.
    """
    taken = {*COUNTS, "n_best", "count_sum"}
    if clash := {k.lower() for k in keep} & taken:
        raise ValueError(f"columns named twice: {sorted(clash)}")
    _, plain, _, back = aside(docs, keep)
    row = "row_number"
    encoded = settle(_encoded(docs, row, a, b, keep, text), "alignment-pairs")
    own = Aligner(a, b)
    identity, width, n_a = own.identity, own.width, len(own.sizes[0])
    counts = settle(_counted(encoded, identity, width), "alignment-counts")

    # Vectors as long as the vocabulary, and at most `frequent` pairs beside them.
    first = F.floor(F.col("pair") / F.lit(width)).cast("long")
    ids, tops = _numbers(counts.groupBy(first.alias("a")).agg(F.max("n").alias("n"))
                         .select("a", "n"))
    highest = np.zeros(n_a, dtype=np.int64)
    highest[ids] = tops
    pair, n = _numbers(counts.filter("exact").select("pair", "n"))
    exact = np.zeros(n_a, dtype=np.int64)
    exact[pair // width] = n
    floor = _frequent_floor(counts, frequent)
    pair, n = _numbers(counts.filter(F.col("n") >= floor).select("pair", "n"))
    order = np.argsort(pair)
    often, often_n = pair[order], n[order]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per text with what the vectors know, and one per pair that they do not."""
        for batch in batches:
            rows = batch.column(0).to_numpy()
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            at = pc.list_parent_indices(lists).to_numpy()
            a, b = np.divmod(pairs, width)
            n = np.zeros(len(pairs), dtype=np.int64)
            is_exact = identity[a] == b
            n[is_exact] = exact[a[is_exact]]
            if len(often):
                place = np.minimum(np.searchsorted(often, pairs), len(often) - 1)
                hit = often[place] == pairs
                n[hit] = often_n[place[hit]]
            rest = n == 0
            best = np.bincount(at, weights=np.where(n == highest[a], times, 0) * ~rest,
                               minlength=len(rows)).astype(np.int64)
            total = np.zeros(len(rows), dtype=np.int64)
            np.add.at(total, at, n * times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(best), pa.array(total), pa.nulls(len(rows), pa.int64()),
                 pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names=weighed)
            if rest.any():
                none = pa.nulls(int(rest.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[at[rest]]), none, none, pa.array(pairs[rest]),
                     pa.array(times[rest].astype(np.int64)), pa.array(highest[a[rest]])],
                    names=weighed)

    weighed = [row, "best", "total", "pair", "times", "top"]
    parts = encoded.select(row, "pairs", "times").mapInArrow(
        weigh, f"{row} long, best long, total long, pair long, times long, top long")
    known = parts.filter("pair IS NULL").select(row, "best", "total")
    rare = counts.filter((F.col("n") < floor) & ~F.col("exact")).select("pair", "n")
    joined = (parts.filter("pair IS NOT NULL").join(rare, "pair")
              .select(row, F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)
                      .alias("best"), (F.col("n") * F.col("times")).alias("total")))
    totals = (known.union(joined).groupBy(row)
              .agg(F.sum("best").alias("n_best"), F.sum("total").alias("count_sum")))
    return (encoded.select(row, *plain, *COUNTS).join(totals, row)
            .select(*back, *COUNTS[:4], "n_best", "count_sum", "groups_sha256"))
