"""Removal of repeated byte strings: every byte that some string of 200 bytes covers which
also begins anywhere else, in the same text or another.

1. Anchors (`anchors.py`) give each text a few places chosen by content; equal strings have
   equal anchors. Anchors whose gram occurs at one place only cannot be part of a repeat.
2. Every string belongs to one anchor that it holds, equal strings to equal anchors. What can
   repeat lies in the context of an anchor: the bytes of all strings that belong to it. Equal
   contexts of a gram are one context that stands for several places.
3. The contexts of a gram are read through a Burrows-Wheeler transform (`intervals.py`) whose
   intervals are expanded breadth first up to 200 bytes; what is not parted by then repeats.
4. Spans found in a context hold at each of its places. They are merged per text and cut out.

A gram with more than `GROUP` contexts is not read in one piece. Its strings are told apart
by where the gram lies in them: a range of such offsets has a core that all its strings share,
and contexts are grouped by that core; equal hulls of a range are one again. Ranges become
shorter until a group is small, or the range is one offset and equality decides.

Texts are grouped by a 64-bit hash and their length; contexts by 64-bit hashes within one
gram. Defined results: a null text is the empty text; texts below 200 bytes lose nothing;
texts that occur twice are repeats of each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm import anchors
from attesta.llm.anchors import MATCH, SIDE
from attesta.llm.common import settle
from attesta.llm.intervals import repeated_starts

#: Most contexts of a group that are read in one piece, and bytes read at a time.
GROUP = 600
READ_BYTES = 24 << 10
#: Bytes of texts whose anchors are settled together.
TOGETHER = 4 << 20
#: Numbers of offsets in a range, level by level.
RANGES = (SIDE + 1, 26, 6, 1)

FOUND = "g long, c long, lo int, hi int"
CONTEXT = "g long, c long, key long, pos int, often boolean, at int, data binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, n, text): texts are told apart by their hash and length."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("key"),
                       F.octet_length(body).cast("long").alias("n"), body.alias("text"))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """One row per anchor of the distinct texts of a task that strings belong to; `span` is the
    number of context bytes before it, times 512, plus the length of its context."""
    def rows(keys: list[int], parts: list[bytes], found: list[tuple]) -> pa.RecordBatch:
        counts = [len(at) for at, _ in found]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        begin = np.repeat(begins, counts)
        at = np.concatenate([at for at, _ in found]) + begin
        h = np.concatenate([h for _, h in found])
        lo, hi = anchors.claims(at, h, begin, np.repeat(begins + sizes - MATCH, counts))
        held = lo <= hi
        at, h, begin, lo, end = at[held], h[held], begin[held], lo[held], hi[held] + MATCH
        view = memoryview(b"".join(parts))
        c = np.array(list(map(anchors.context_hash, repeat(view), lo.tolist(), end.tolist(),
                              at.tolist())), dtype=np.uint64)
        key = np.repeat(np.array(keys, dtype=np.int64), counts)[held]
        span = ((at - lo) << 9 | (end - lo)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(key),
             pa.array((at - begin).astype(np.int32)), pa.array(span)],
            names=["g", "c", "key", "pos", "span"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, parts, found, size = [], [], [], 0
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                parts.append(value.as_py().encode("utf-8", "replace"))
                keys.append(key)
                found.append(anchors.find(parts[-1]))
                size += len(parts[-1])
                if size >= TOGETHER:
                    yield rows(keys, parts, found)
                    keys, parts, found, size = [], [], [], 0
            if keys:
                yield rows(keys, parts, found)

    return (texts.filter(F.col("n") >= MATCH).select("key", "text")
            .mapInArrow(work, "g long, c long, key long, pos int, span int"))


def _members(rows: DataFrame) -> DataFrame:
    """Anchors of grams found at two places or more: whether their context is (`often`), and
    which place stands for it (`first`)."""
    place = F.xxhash64("key", "pos")
    context, gram = Window.partitionBy("g", "c"), Window.partitionBy("g")
    known = (rows.repartition("g").withColumn("place", place)
             .withColumn("lo", F.min("place").over(context))
             .withColumn("hi", F.max("place").over(context)))
    known = (known.withColumn("first", F.col("place") == F.col("lo"))
             .withColumn("least", F.min("lo").over(gram)).withColumn("most", F.max("hi").over(gram)))
    return (known.filter(F.col("least") != F.col("most"))
            .select("g", "c", "key", "pos", "span", (F.col("lo") != F.col("hi")).alias("often"),
                    "first"))


def _packed(texts: DataFrame) -> DataFrame:
    """(key, z): distinct texts long enough to repeat, compressed before they are shuffled."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = set(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys, packed = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    packed.append(pack(value.as_py().encode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["key", "z"])

    rows = (texts.filter(F.col("n") >= MATCH).select("key", "text")
            .mapInArrow(work, "key long, z binary"))
    return rows.groupBy("key").agg(F.first("z").alias("z"))


def _contexts(texts: DataFrame, members: DataFrame) -> DataFrame:
    """One row per gram and context: its bytes, a place it has, and the gram's number of
    contexts (`size`)."""
    wanted = (members.filter("first").repartition("g").groupBy("g", "c")
              .agg(F.min(F.struct("key", "pos", "span")).alias("p"), F.max("often").alias("often"))
              .withColumn("size", F.count("*").over(Window.partitionBy("g"))))
    # At most one entry per anchor of the text.
    wanted = (wanted.groupBy(F.col("p.key").alias("key"))
              .agg(F.collect_list(F.struct("g", "c", F.col("p.pos").alias("pos"), "often", "size",
                                         F.col("p.span").alias("span"))).alias("wanted")))
    fields = ("g", "c", "pos", "often", "size")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for key, z, wants in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack(z)
                columns = [pa.array([w[f] for w in wants], k) for f, k in zip(fields, kinds)]
                at = [w["span"] >> 9 for w in wants]
                begins = [w["pos"] - a for w, a in zip(wants, at)]
                found = [data[b:b + (w["span"] & 511)] for w, b in zip(wants, begins)]
                yield pa.RecordBatch.from_arrays(
                    [*columns[:2], pa.array([key] * len(at), pa.int64()), *columns[2:],
                     pa.array(at, pa.int32()), pa.array(found, pa.binary())],
                    names=["g", "c", "key", "pos", "often", "size", "at", "data"])

    return (_packed(texts).join(wanted, "key").select("key", "z", "wanted")
            .mapInArrow(work, "g long, c long, key long, pos int, often boolean, size long, "
                              "at int, data binary"))


def _merged(starts: np.ndarray, at: int) -> tuple[list[int], list[int]]:
    """Spans covered by strings beginning at `starts`, relative to the gram."""
    cut = np.nonzero(np.diff(starts) > MATCH)[0]
    lo = starts[np.concatenate([[0], cut + 1])] - at
    hi = starts[np.concatenate([cut, [len(starts) - 1]])] + MATCH - at
    return lo.tolist(), hi.tolist()


def _read(contexts: DataFrame) -> DataFrame:
    """Spans per context (relative to its gram), by expansion of intervals."""
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        # The first byte of a context is a place of its text; places that wrap stay distinct.
        with np.errstate(over="ignore"):
            places = (np.array([r[2] for r in rows], dtype=np.int64)
                      + np.array([r[3] - r[5] for r in rows], dtype=np.int64))
        starts = repeated_starts([r[6] for r in rows], places,
                                 np.array([r[4] for r in rows], dtype=bool), MATCH)
        out = ([], [], [], [])
        for r, s in zip(rows, starts):
            if len(s):
                lo, hi = _merged(s, r[5])
                for column, values in zip(out, ([r[0]] * len(lo), [r[1]] * len(lo), lo, hi)):
                    column.extend(values)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            names=["g", "c", "lo", "hi"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups follow each other; whole groups are read together until there is enough.
        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != last and size >= READ_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                last = r[0]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield solve(rows)

    return (contexts.select("g", "c", "key", "pos", "often", "at", "data").repartition("g")
            .sortWithinPartitions("g").mapInArrow(work, FOUND))


def _refined(contexts: DataFrame, level: int) -> DataFrame:
    """Spans of the contexts of large groups, from shorter ranges of offsets."""
    width = RANGES[level]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(9)]
            for g, c, key, pos, often, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                for d in range(0, SIDE + 1, width):
                    last = min(d + width - 1, SIDE)
                    # Strings of the range begin between at - last and at - d.
                    if at - d < 0 or at - last + MATCH > len(data):
                        continue
                    lo, hi = max(0, at - last), min(len(data), at - d + MATCH)
                    core = data[max(0, at - d):at - last + MATCH]
                    if hi - lo < MATCH:
                        continue
                    name = xxhash.xxh3_64_intdigest(core, (g ^ d) & (1 << 64) - 1)
                    hull = xxhash.xxh3_64_intdigest(data[lo:hi], at - lo)
                    for column, value in zip(out, (g, c, _signed(name), _signed(hull), key, pos,
                                                   often, at - lo, data[lo:hi])):
                        column.append(value)
            kinds = (pa.int64(),) * 5 + (pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(out, kinds)],
                names=["up_g", "up_c", "g", "c", "key", "pos", "often", "at", "data"])

    parts = settle(contexts.select("g", "c", "key", "pos", "often", "at", "data").mapInArrow(
        work, "up_g long, up_c long, " + CONTEXT), "repeat-ranges")
    place = F.xxhash64("key", "pos")
    single = (parts.groupBy("g", "c").agg(
        F.min(F.struct("key", "pos")).alias("p"), (F.min(place) != F.max(place)).alias("two"),
        F.max("often").alias("often"), F.first("at").alias("at"), F.first("data").alias("data"))
        .select("g", "c", "p.key", "p.pos", (F.col("often") | F.col("two")).alias("often"), "at",
                "data"))
    # A gram whose range has one hull in all is decided by that hull's places.
    sizes = single.groupBy("g").agg(F.count("*").alias("size"))
    found = _spans(settle(single.join(sizes, "g"), "repeat-hulls"), level)
    return (found.join(parts.select("up_g", "up_c", "g", "c"), ["g", "c"])
            .select(F.col("up_g").alias("g"), F.col("up_c").alias("c"), "lo", "hi").distinct())


def _spans(contexts: DataFrame, level: int = 0) -> DataFrame:
    """Spans per context of groups of any size (column `size`)."""
    if RANGES[level] == 1:
        # A range of one offset is one string: equal ones are one hull.
        return contexts.filter("often").select(
            "g", "c", (-F.col("at")).alias("lo"), (MATCH - F.col("at")).alias("hi"))
    # A gram with one context has nothing to compare: it is that context at all its places.
    whole = contexts.filter("size = 1 AND often").select(
        "g", "c", (-F.col("at")).alias("lo"),
        (F.octet_length("data") - F.col("at")).alias("hi")).filter(F.col("hi") - F.col("lo") >= MATCH)
    found = _read(contexts.filter((F.col("size") > 1) & (F.col("size") <= GROUP))).union(whole)
    large = contexts.filter(F.col("size") > GROUP)
    if large.isEmpty():
        return found
    return found.union(_refined(large, level + 1))


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): per text with repeats the spans to remove, not yet merged."""
    texts = _texts(docs, doc_id, text)
    members = settle(_members(_anchor_rows(texts)), "repeat-members")
    found = settle(_spans(settle(_contexts(texts, members), "repeat-contexts")), "repeat-spans")
    # At most a few entries per anchor of the text.
    return (members.select("g", "c", "key", "pos").join(found, ["g", "c"])
            .groupBy("key").agg(F.collect_set(F.struct((F.col("pos") + F.col("lo")).alias("a"),
                                                       (F.col("pos") + F.col("hi")).alias("b")))
                                .alias("spans")))


def cut(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), [tuple(r) for r in runs]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   with_kept: bool = True) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, runs (begin and end in bytes),
    kept_sha256 and, if asked for, kept (the bytes left)."""
    texts = _texts(docs, doc_id, text)
    kind = docs.schema[doc_id].dataType.simpleString()
    spans = find_spans(docs, doc_id, text)
    copies = (texts.filter(F.col("n") >= MATCH).groupBy("key").agg(F.count("*").alias("copies"))
              .filter("copies > 1"))
    marks = spans.join(copies, "key", "full").select("key", "spans", "copies")
    fields = (f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, "
              "runs array<struct<begin:int,end:int>>, kept_sha256 string")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [press(v.as_py().encode("utf-8", "replace")) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(z, pa.binary())],
                names=["doc_id", "key", "z"])

    packed = texts.select("doc_id", "key", "text").mapInArrow(
        pack, f"doc_id {kind}, key long, z binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = ([], [], [], [], [], [])
            for z, found, copied in zip(*(c.to_pylist() for c in batch.columns[1:])):
                data = unpack(z)
                wanted = [(0, len(data))] if copied else [(s["a"], s["b"]) for s in found or []]
                kept, runs = cut(data, wanted)
                for column, value in zip(out, (
                        len(data), len(data) - len(kept), len(runs),
                        [{"begin": a, "end": b} for a, b in runs],
                        hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(),
                     pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])),
                     pa.string(), pa.binary())
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "runs", "kept_sha256", "kept"]
            n = len(names) if with_kept else len(names) - 1
            yield pa.RecordBatch.from_arrays(columns[:n], names=names[:n])

    return (packed.join(marks, "key", "left").select("doc_id", "z", "spans", "copies")
            .mapInArrow(work, fields + (", kept binary" if with_kept else "")))
