"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8
or more.

A fingerprint has 1,024 bits in 128 pieces of eight. In every piece the shingles vote with weights
of the piece's own, drawn from their hashes, and a bit is set by the weighted majority. With equal
weights, as in op4, every bit of a near copy may flip, about 10 of 64 at 0.8, and no block wide
enough to tell texts apart survives. The weights here spread so far (the fourth power of a uniform
draw's inverse) that a piece hangs on few shingles: at 0.8 near copies have 77 of 100 pieces whole,
unrelated texts none but by chance.

Fingerprints that agree in one of 32 blocks of four pieces are candidates; a pair at exactly 0.8
shares no block with a probability below 1e-6. Of these only pairs at `MOST_BITS` differing bits or
fewer are looked at (a pair at 0.8 has 106 on average, with a deviation of 19; one at 0.5 has 260),
and every link is verified on the whole shingle sets.

Texts with equal sets are one node. Only classes are wanted, so a pair inside a class needs no
look. First the members of each block's bucket are measured against the member that shares most
buckets, a row per member, which settles most buckets. Buckets that then still hold several classes
are cells: their members come together in one task, a large bucket as blocks of bounded size that
meet two by two, first by fingerprint, then the texts of those that reach another class, and overlaps are added up over an inverted list of their shingles. So a text travels once
per bucket (equal buckets count once), compressed, never once per pair, and a cell gives at most as
many links as it has classes.

Defined results: word-free and null texts have the empty set and are copies of each other; texts
with fewer than five words have one shingle, the whole word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import aside, lower_words_of, map_arrow, settle
from attesta.llm.components import components
from attesta.llm.simhash import shingle_hashes
from attesta.session import materialize

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Pieces of a fingerprint, votes in a piece, and pieces of a block.
PIECES = 128
BITS = 8
BLOCK = 4
#: Most bits in which the fingerprints of near copies differ: five and a half deviations over the
#: mean at the least similarity.
MOST_BITS = 210
#: Members of a block: a larger bucket is several blocks, and a cell is two at most.
CELL_ROWS = 512
#: Members up to which a cell is compared pair by pair.
FEW = 6
_FACTORS = np.random.default_rng(11).integers(
    0, 1 << 63, PIECES, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
#: Shingles whose products are formed together.
_PART = 2048


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct hashes of all shingles of a whole text, in order."""
    return np.unique(np.array(shingle_hashes(lower_words_of(text), SHINGLE), dtype=np.uint64))


def _drawn(found: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per piece and shingle its votes and its weight. Of a product the upper bits draw the weight,
    the bits below them are the votes."""
    drawn = factors * found
    weight = (drawn >> np.uint64(40)).astype(np.float32)
    weight += 1
    weight *= np.float32(2 ** -24)
    weight *= weight
    weight *= weight
    return (drawn >> np.uint64(32)).astype(np.uint8), np.reciprocal(weight, out=weight)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The pieces of a set's fingerprint as 64-bit numbers, eight pieces in each; none if empty."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    every = np.arange(PIECES)
    bits = np.zeros(PIECES, dtype=np.uint8)
    most, total = np.zeros((2, PIECES), dtype=np.float32)
    for at in range(0, len(found), _PART):
        votes, weight = _drawn(found[at:at + _PART], _FACTORS)
        top = weight.argmax(axis=1)
        own = weight[every, top]
        bits = np.where(own > most, votes[every, top], bits)
        most = np.maximum(most, own)
        total += weight.sum(axis=1)
    # A shingle that outweighs all others together decides its piece. Elsewhere all are added up.
    left = np.flatnonzero(2 * most <= total * np.float32(1.001))
    sums = np.zeros((len(left), BITS), dtype=np.float32)
    for at in range(0, len(found) if len(left) else 0, _PART):
        votes, weight = _drawn(found[at:at + _PART], _FACTORS[left])
        signs = np.unpackbits(votes[:, :, None], axis=2, bitorder="little").astype(np.float32)
        signs *= 2
        signs -= 1
        sums += np.matmul(weight[:, None, :], signs)[:, 0]
    bits[left] = np.packbits(sums > 0, axis=1, bitorder="little")[:, 0]
    return bits.view("<i8")


def _blocks(fp: Column) -> Column:
    """A number per block of a fingerprint: its place and its pieces."""
    low = lambda x, i: (2 * i).cast("long") * F.lit(1 << 32) + x.bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda x, i: low(F.shiftrightunsigned(x, 32), i) + F.lit(1 << 32)
    return F.concat(F.transform(fp, low), F.transform(fp, high))


def _distance(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda total, n: total + n)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) if len(a) else 0


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _signed_rows(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, kept columns, a digest of the text, node (the digest of the set), its size and its
    fingerprint."""
    kept, plain, types, _ = aside(docs, (doc_id, *keep))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(len(keep) + 2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(map(_digest, sets), pa.binary()),
                 pa.array(map(len, sets), pa.int64()),
                 pa.array(map(fingerprint, sets), pa.list_(pa.int64()))],
                names=[*plain, "text_key", "node", "size", "fp"])

    return map_arrow(docs, [*kept, _key(text), F.col(f"`{text}`").alias("text")], work,
                     f"{types}text_key binary, node binary, size long, fp array<long>")


def _key(text: str) -> Column:
    """A 16-byte name of a text."""
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("text_key")


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """(text_key, z): the texts, compressed before they are shuffled."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [press((t.as_py() or "").encode("utf-8", "replace")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())],
                                             names=["text_key", "z"])

    return map_arrow(docs, [_key(text), F.col(f"`{text}`").alias("text")], work,
                     "text_key binary, z binary")


def _set_of(z: bytes) -> np.ndarray:
    return shingle_set(zstandard.decompress(z).decode("utf-8"))


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    common = shared(a, b)
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [_alike(_set_of(x), _set_of(y))
                    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(
                pa.array(near, pa.bool_()))

    return (pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("y")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("z").alias("x")), "a")
            .select("a", "b", "x", "y").mapInArrow(work, "a binary, b binary"))


class Cell:
    """Members of a bucket, or of two blocks of one, and the links their sets give between roots."""

    def __init__(self):
        self.blocks: list[int] = []
        self.roots: list = []
        self.sets: list[np.ndarray] = []

    def add(self, block: int, root: bytes, found: np.ndarray) -> None:
        self.blocks.append(block)
        self.roots.append(root)
        self.sets.append(found)

    def links(self) -> list[tuple]:
        """Enough links to join all classes that alike members join."""
        top = {r: r for r in self.roots}

        def find(r: bytes) -> bytes:
            while top[r] != r:
                top[r] = top[top[r]]
                r = top[r]
            return r

        links = []
        for i, j in self._near(find):
            a, b = find(self.roots[i]), find(self.roots[j])
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((a, b))
        return links

    def _near(self, find) -> Iterator[tuple[int, int]]:
        """Alike pairs of different classes; pairs of one block belong to that block's own cell."""
        n, two = len(self.sets), len(set(self.blocks)) > 1
        if n <= FEW:
            for i in range(n):
                for j in range(i):
                    if (find(self.roots[i]) != find(self.roots[j])
                            and not (two and self.blocks[i] == self.blocks[j])
                            and _alike(self.sets[i], self.sets[j])):
                        yield i, j
            return
        size = np.array([len(s) for s in self.sets])
        _, number = np.unique(np.concatenate(self.sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(number, kind="stable")
        held, begins = owner[order], np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
        block, at = np.array(self.blocks), np.concatenate([[0], np.cumsum(size)])
        for i in range(n):
            mine = number[at[i]:at[i + 1]]
            begin, many = begins[mine], begins[mine + 1] - begins[mine]
            places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(held[places], minlength=n)
            near = LEAST[1] * common >= LEAST[0] * (size[i] + size - common)
            near[i:] = False
            if two:
                near &= block != block[i]
            for j in np.flatnonzero(near):
                if find(self.roots[i]) != find(self.roots[j]):
                    yield i, int(j)


def _cells(members: DataFrame, carried: DataFrame, schema: str, work) -> DataFrame:
    """Rows of `work(rows)` for the rows (block, root, band, node, carried column) of every cell.

    `members`: band, node, root, for buckets with several classes. Of buckets with the same members
    one is looked at: they are told apart by their number and two digests, 128 bits, of them.
    """
    told = members.groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(F.xxhash64("node", F.lit(7))).alias("xor"))
    once = told.groupBy("n", "sum", "xor").agg(F.min("band").alias("band")).select("band", "n")
    blocks = F.ceil(F.col("n") / F.lit(CELL_ROWS)).cast("int")
    placed = (members.join(once, "band").withColumn("blocks", blocks)
              .withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    what = [c for c in carried.columns if c != "node"]
    cells = (placed.select("band", F.least("block", "other").alias("i"),
                           F.greatest("block", "other").alias("j"), "block", "root", "node")
             .join(carried, "node").select("i", "j", "block", "root", "band", "node", *what)
             .repartition("band", "i", "j").sortWithinPartitions("band", "i", "j"))
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

        key, rows = None, []
        for batch in batches:
            found = []
            for i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[2], i, j) != key:
                    found += work(rows)
                    key, rows = (row[2], i, j), []
                rows.append(row)
            if found:
                yield done(found)
        if last := work(rows):
            yield done(last)

    return cells.mapInArrow(run, schema).distinct()


def _in_reach(members: DataFrame, known: DataFrame) -> DataFrame:
    """The members whose fingerprint is near that of a member of another class in their bucket."""
    def work(rows: list) -> list[tuple]:
        fps = np.array([r[4] for r in rows], dtype=np.int64)
        _, roots = np.unique([r[1].hex() for r in rows], return_inverse=True)
        block = np.array([r[0] for r in rows])
        two, out = len(set(block.tolist())) > 1, []
        for i, (_, root, band, node, _) in enumerate(rows):
            near = np.bitwise_count(fps ^ fps[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS
            near &= roots != roots[i]
            if two:
                near &= block != block[i]
            if near.any():
                out.append((band, node, root))
        return out

    return _cells(members, known.select("node", "fp"), "band long, node binary, root binary", work)


def _links_in_cells(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between roots that alike members of open buckets give."""
    def work(rows: list) -> list[tuple]:
        cell = Cell()
        for block, root, _, _, z in rows:
            cell.add(block, root, _set_of(z))
        return cell.links()

    return _cells(members, texts, "a binary, b binary", work)


def _renamed(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows whose root went over into another one of `ends` (node, root)."""
    ends = ends.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    return (rows.join(ends, F.col("root") == F.col("_old"), "left")
            .withColumn("root", F.coalesce("_new", "root")).drop("_old", "_new"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, kept columns, `root`, which names the class of texts
    that near copies link. Runs jobs while it is built."""
    rows = settle(_signed_rows(docs, doc_id, text, keep), "near-rows")
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"),
                                     F.min("text_key").alias("text_key"))
    listed = rows.select("node", "fp").dropDuplicates(["node"]).select(
        "node", F.explode(_blocks(F.col("fp"))).alias("band"))
    several = listed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = settle(listed.join(several, "band"), "near-buckets")

    # One text of every candidate is read again.
    known = settle(nodes.join(members.select("node").distinct(), "node", "left_semi"), "near-nodes")
    texts = settle(_packed(docs, text).join(known.select("node", "text_key"), "text_key")
                   .groupBy("node").agg(F.first("z").alias("z")), "near-texts")

    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    middle = (members.join(weights, "node").groupBy("band")
              .agg(F.max(F.struct("weight", "node")).alias("m"))
              .select("band", F.col("m.node").alias("a")))
    side = lambda end: known.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"),
                                    F.col("fp").alias(f"fp_{end}"))
    likely = (F.lit(LEAST[1]) * F.least("size_a", "size_b")
              >= F.lit(LEAST[0]) * F.greatest("size_a", "size_b"))
    stars = (members.join(middle, "band").filter("a != node")
             .select("a", F.col("node").alias("b")).distinct()
             .join(side("b"), "b").join(side("a"), "a").filter(likely)
             .filter(_distance(F.col("fp_a"), F.col("fp_b")) <= MOST_BITS).select("a", "b"))
    first = settle(_verified(stars, texts), "near-links")

    placed = _renamed(members.select("band", "node", F.col("node").alias("root")),
                      components(first))
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    left = materialize(placed.join(open_.filter("low != high").select("band"), "band", "left_semi"),
                       "near-open")
    reach = settle(_in_reach(left, known), "near-reach")
    second = settle(_links_in_cells(reach, texts), "near-links")

    ends = components(first.union(second)).withColumnRenamed("node", "own")
    _, plain, _, back = aside(docs, (doc_id, *keep))
    return (rows.join(ends, rows["node"] == ends["own"], "left")
            .select(*plain, F.coalesce("root", "node").alias("root")).select(*back, "root"))
