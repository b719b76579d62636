"""Hard-negative mining: exact integer scores by the method of the Four Russians.

Components become whole numbers, floor(scale * x). Dimensions go in groups of eight; the bits of
one weight (a bit plane) of a group's eight components are one byte of a candidate. An anchor's
table of a group holds the sums of all 256 subsets of its eight components, so one lookup per
byte gives that plane's share of the inner product, and shifting and adding over the planes (the
sign plane counts negative) gives the full score: exact, without a multiplication.

Candidates are packed where they are scanned into blocks of bounded size, anchors likewise. Blocks
are rows: every pair of an anchor block and a candidate block meets in one grouped Arrow step (a
cell), which keeps the first rows per anchor only. Neither side is broadcast or collected, the
plan is the same for ten anchors and for ten million, and rows of one label may be any share of
the table: blocks are cut by size, not by label.

Two passes: positives among the rows of an anchor's label, then negatives among all others, inside
the window that each positive's score opens. Together they score every pair of an anchor and a row
once.

Defined results: a row with a null id, a null label, a null vector, a null or non-finite
component, or one whose whole number leaves 28 bits (a score of such would not fit a long) takes
no part. A missing component of a shorter vector counts as zero, so an
empty vector scores 0. Ties go to the smaller id. An
anchor row that repeats in all three columns is mined once; a candidate row counts as often as it
stands; rows with the anchor's own id are neither its positives nor its negatives. An anchor
without positives, and a positive without rows in its window, give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.llm.common import settle

#: Rows of a candidate block and anchors of an anchor block: a cell's memory and work.
BLOCK_ROWS = 16384
ANCHOR_ROWS = 8192
#: Anchors whose tables lie side by side, so that one lookup serves them all.
LANES = 16
#: Rows scored in one go: their sums stay in a core's cache.
STRETCH = 2048
#: Cells handed to a task's Python at a time; each holds two blocks.
CELLS_AT_ONCE = 4
#: Whole numbers lie below this in size, so that scores of up to 2**9 dimensions fit 63 bits.
LIMIT = 1 << 27

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def packed(values: np.ndarray) -> np.ndarray:
    """Two's complement bit planes, top plane (the sign) first: (planes, groups, rows) bytes."""
    rows, dims = values.shape
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    planes = most.bit_length() + 1
    padded = np.zeros((rows, -dims % 8 + dims), dtype=np.int64)
    padded[:, :dims] = values
    return np.stack([np.packbits((padded >> p & 1).astype(np.uint8), axis=1).T
                     for p in range(planes - 1, -1, -1)])


def tables(anchors: np.ndarray, groups: int, planes: int) -> np.ndarray:
    """Sums of all subsets of each group's eight components: (groups, 256, anchors), in 32 bits
    where every score over so many planes fits them."""
    padded = np.zeros((len(anchors), groups * 8), dtype=np.int64)
    dims = min(anchors.shape[1], groups * 8)
    padded[:, :dims] = anchors[:, :dims]
    made = np.einsum("sd,agd->gsa", _BITS, padded.reshape(len(anchors), groups, 8))
    narrow = int(np.abs(padded).sum(axis=1).max(initial=0)) << planes < 1 << 31
    return made.astype(np.int32 if narrow else np.int64)


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (anchors, rows) of the anchors of a table with packed rows."""
    out = np.empty((table.shape[2], planes.shape[2]), dtype=np.int64)
    for begin in range(0, planes.shape[2], STRETCH):
        stretch = planes[:, :, begin:begin + STRETCH]
        total = np.zeros((stretch.shape[2], table.shape[2]), dtype=table.dtype)
        looked = np.empty_like(total)
        for p, plane in enumerate(stretch):
            total <<= 1
            for group, of in zip(plane, table):
                np.take(of, group, axis=0, out=looked, mode="clip")
                total += looked
            if p == 0:
                np.negative(total, out=total)
        out[:, begin:begin + STRETCH] = total.T
    return out


def first_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first rows: higher scores first, ties by the smaller id."""
    places = np.arange(len(score))
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        sure = places[score > floor]
        tied = places[score == floor]
        tied = tied[np.argsort(ids[tied], kind="stable")[:k - len(sure)]]
        places = np.concatenate([sure, tied])
    return places[np.lexsort((ids[places], -score[places]))]


def _clean(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """(vec_id, label, values): the rows that take part, components as whole numbers."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x.cast("double")) < F.lit(LIMIT / scale)))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                           & F.col("embedding").isNotNull())
            .filter(sound)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    label.cast("long").alias("label"), whole.alias("values")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


BLOCK = "ids binary, labels binary, planes long, groups long, body binary"


def _candidate_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of packed rows, sorted by label and id inside. Numbers are given by the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            order = np.lexsort((ids, labels))
            planes = packed(_matrix(table.column("values").combine_chunks())[order])
            return _one_row(names, [ids[order].tobytes(), labels[order].tobytes(),
                                    planes.shape[0], planes.shape[1], planes.tobytes()])

        held, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, block_rows):
                piece = batch.slice(begin, block_rows)
                if size + piece.num_rows > block_rows:
                    yield block(held)
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if held:
            yield block(held)

    names = [c.split()[0] for c in BLOCK.split(", ")]
    return rows.mapInArrow(work, BLOCK).withColumn("part", F.monotonically_increasing_id())


def _one_row(names: list[str], values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)


SIDE = ("a_block long, akeys binary, a_ids binary, a_labels binary, dims long, a_values binary, "
        "offsets binary, windows binary")


def _anchor_blocks(anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Anchors (akey, vec_id, label, values, windows) in blocks, dealt by a hash of their key."""
    names = [c.split()[0] for c in SIDE.split(", ")]

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        values = _matrix(table.column("values").combine_chunks())
        windows = table.column("windows").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(windows.value_lengths().to_numpy())])
        return pa.Table.from_batches([_one_row(names, [
            key[0].as_py(), *(table.column(c).to_numpy().tobytes()
                              for c in ("akey", "vec_id", "label")),
            values.shape[1], values.tobytes(), offsets.astype(np.int64).tobytes(),
            windows.flatten().to_numpy().tobytes()])])

    return (anchors.withColumn("a_block", F.pmod(F.xxhash64("akey"), F.lit(n_blocks)).cast("long"))
            .groupBy("a_block").applyInArrow(pack, SIDE))


def _over_cells(blocks: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """`work(anchor block, candidate block)` for every pair of an anchor and a candidate block.

    Candidate blocks are repeated per anchor block and anchor blocks per stripe of candidate
    blocks; the two meet on (anchor block, stripe). With few anchor blocks there are as many
    stripes as keep the cluster busy, with many a stripe holds eight candidate blocks.
    """
    n_blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    n_parts = max(1, blocks.count())
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    stripes = max(-(-n_parts // 8), min(n_parts, -(-4 * cores // n_blocks)))
    packed_anchors = settle(_anchor_blocks(anchors, n_blocks), "negatives-anchors")
    left = (blocks.withColumn("stripe", F.pmod(F.xxhash64("part"), F.lit(stripes)))
            .withColumn("a_block", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.lit(n_blocks - 1).cast("long")))))
    right = packed_anchors.withColumn(
        "stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                yield from work(_Anchors(cell), _Rows(cell))

    names = [c.split()[0] for c in f"{SIDE}, {BLOCK}".split(", ")]
    cells = left.join(right, ["a_block", "stripe"]).select(*names)
    with _batches_of(cells.sparkSession, CELLS_AT_ONCE):
        return settle(cells.mapInArrow(run, schema), "negatives-cells")


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand so many rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Rows:
    """A candidate block: ids and labels sorted by (label, id), and the packed bytes."""

    def __init__(self, cell: dict):
        self.ids, self.labels = (np.frombuffer(cell[c], dtype=np.int64) for c in ("ids", "labels"))
        self.planes = np.frombuffer(cell["body"], dtype=np.uint8).reshape(
            cell["planes"], cell["groups"], len(self.ids))

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


class _Anchors:
    """An anchor block; `lanes` gives anchors of one label, some at a time."""

    def __init__(self, cell: dict):
        self.keys, self.ids, self.labels, self.offsets, self.windows = (
            np.frombuffer(cell[c], dtype=np.int64)
            for c in ("akeys", "a_ids", "a_labels", "offsets", "windows"))
        self.values = np.frombuffer(cell["a_values"], dtype=np.int64).reshape(
            len(self.ids), cell["dims"])

    def lanes(self) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(self.labels, kind="stable")
        for label in np.unique(self.labels):
            mine = order[slice(*np.searchsorted(self.labels[order], [label, label + 1]))]
            for begin in range(0, len(mine), LANES):
                yield int(label), mine[begin:begin + LANES]

    def scores(self, lane: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return scores(tables(self.values[lane], planes.shape[1], planes.shape[0]), planes)


def _best_alike(k: int):
    """First k rows of the anchor's own label, itself left out, per cell."""

    def work(anchors: _Anchors, rows: _Rows) -> Iterator[pa.RecordBatch]:
        found = []
        for label, lane in anchors.lanes():
            at = rows.of(label)
            ids = rows.ids[at]
            if not len(ids):
                continue
            for a, score in zip(lane, anchors.scores(lane, rows.planes[:, :, at])):
                other = np.flatnonzero(ids != anchors.ids[a])
                first = other[first_rows(score[other], ids[other], k)]
                found.append((np.full(len(first), anchors.keys[a]), ids[first], score[first]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                             names=["akey", "vec_id", "score"])

    return work


def _best_unlike(k: int, low: int, high: int, whole: int):
    """First k rows of other labels inside the window of each positive score, per cell."""

    def work(anchors: _Anchors, rows: _Rows) -> Iterator[pa.RecordBatch]:
        found = []
        for label, lane in anchors.lanes():
            at = rows.of(label)
            sides = [slice(0, at.start), slice(at.stop, len(rows.ids))]
            ids = np.concatenate([rows.ids[s] for s in sides])
            if not len(ids):
                continue
            scored = np.concatenate([anchors.scores(lane, rows.planes[:, :, s]) for s in sides], 1)
            for a, score in zip(lane, scored):
                windows = [(w, -(-low * w // whole), high * w // whole) for w in
                           anchors.windows[anchors.offsets[a]:anchors.offsets[a + 1]].tolist()]
                near = np.flatnonzero((score >= min(x[1] for x in windows))
                                      & (score <= max(x[2] for x in windows))
                                      & (ids != anchors.ids[a]))
                for w, least, most in windows:
                    inside = near[(score[near] >= least) & (score[near] <= most)]
                    first = inside[first_rows(score[inside], ids[inside], k)]
                    n = len(first)
                    found.append((np.full(n, anchors.keys[a]), np.full(n, w), ids[first],
                                  score[first]))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*found)],
                names=["akey", "positive_score", "vec_id", "score"])

    return work


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, whole: int = 100,
         scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, label and embedding; `label` may replace its label. An anchor's
    positives are its first rows of the same label; for each of them the first rows of other
    labels with low * positive_score <= whole * score <= high * positive_score are returned.
    Runs jobs while the frame is built.
    """
    rows = _clean(vectors, scale, F.col("label") if label is None else label)
    blocks = settle(_candidate_blocks(rows, BLOCK_ROWS), "negatives-rows")
    anchors = settle(rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "values"])
                     .withColumn("akey", F.monotonically_increasing_id()), "negatives-anchors")
    none = F.array().cast("array<long>")
    alike = _over_cells(blocks, anchors.withColumn("windows", none), _best_alike(positives),
                        "akey long, vec_id long, score long")
    alike = settle(_first(alike, ["akey"], positives)
                   .select("akey", F.col("vec_id").alias("positive_id"),
                           F.col("score").alias("positive_score")), "negatives-positives")
    windows = alike.groupBy("akey").agg(F.collect_set("positive_score").alias("windows"))
    unlike = _over_cells(blocks, anchors.join(windows, "akey"),
                         _best_unlike(negatives, low, high, whole),
                         "akey long, positive_score long, vec_id long, score long")
    found = _first(unlike, ["akey", "positive_score"], negatives)
    return (alike.join(found, ["akey", "positive_score"])
            .join(anchors.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
