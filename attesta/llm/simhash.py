"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, classes.

A fingerprint is cut into five pieces. Two differing bits touch two pieces at most, so a
close pair agrees in at least three pieces: it shares one of the ten blocks made of three
pieces. Pairs are formed inside a block and verified by their Hamming distance.

Blocks work on distinct fingerprints, so copies meet no one. A block shared by more than
`PAIRED` fingerprints is not paired: there every fingerprint is listed under itself and under
each flip of one bit outside the block. Two fingerprints of the block differ in two bits or
fewer exactly if they share such a listing, no listing holds more than 27 fingerprints, and
linking a listing to its smallest member gives the same classes as all its pairs.

Defined results: null and word-free texts have fingerprint zero and are linked like any
other; texts with fewer than three words have one shingle, the whole word sequence; repeated
rows are rows of their own with one class; a null id never becomes the name of a class unless
the class has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lower_words_of, map_arrow
from attesta.llm.components import components
from attesta.session import materialize

SEED = 42
SHINGLE = 3
MOST_BITS = 2
PIECES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A block of up to this many fingerprints is paired; more would cost more than listings.
PAIRED = 48
_PART = 1 << 15


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of every window of `size` words, or of all words if they are fewer."""
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(text, SEED)] if words else []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(text[a:b], SEED)
            for a, b in zip(starts.tolist(), ends[size - 1:].tolist())]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in more than half of the shingle hashes."""
    hashes = shingle_hashes(lower_words_of(text), size)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), _PART):
        part = values[at:at + _PART].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, fp: the fingerprint of a whole text as a signed 64-bit number."""
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(len(keep) + 1)],
                             dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)],
                                             names=["doc_id", *keep, "fp"])

    columns = [F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{k}`") for k in keep],
               F.col(f"`{text}`")]
    return map_arrow(docs, columns, work, ", ".join([f"doc_id {kind}", *fields, "fp long"]))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks() -> list[int]:
    """Blocks: the bits of every choice of all pieces but two."""
    masks = []
    for kept in combinations(PIECES, len(PIECES) - MOST_BITS):
        masks.append(sum(((1 << width) - 1) << at for at, width in kept))
    return masks


def links(fps: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints `fp`; enough for all classes."""
    masks = _masks()
    blocks = F.array(*[F.struct(F.lit(i).alias("block"),
                                F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                       for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(blocks).alias("x")).select("fp", "x.block", "x.key")
    shared = rows.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows.join(shared, ["block", "key"]), "simhash-blocks")

    paired = members.filter(F.col("n") <= PAIRED)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    pairs = (paired.select("block", "key", F.col("fp").alias("a"))
             .join(paired.select("block", "key", F.col("fp").alias("b")), ["block", "key"])
             .filter(F.col("a") < F.col("b")).filter(close).select("a", "b"))

    def flips(mask: int) -> list[Column]:
        outside = [1 << bit for bit in range(64) if not mask >> bit & 1]
        return [F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in [0, *outside]]

    listing = F.when(F.lit(False), F.array(F.col("fp")))
    for i, m in enumerate(masks):
        listing = listing.when(F.col("block") == i, F.array(*flips(m)))
    listed = (members.filter(F.col("n") > PAIRED)
              .select("block", "fp", F.explode(listing).alias("near"))
              .groupBy("block", "near").agg(F.collect_set("fp").alias("fps"))
              .filter(F.size("fps") > 1))
    stars = (listed.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
             .filter("a != b").filter(close))
    return pairs.union(stars).distinct()


def classes(found: DataFrame) -> DataFrame:
    """(fp, root, component_id, class_size) from (doc_id, fp): `component_id` is the smallest
    id reachable by links, `root` the fingerprint that names the class."""
    per_fp = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                                 F.count("*").alias("n")), "simhash-fps")
    rooted = components(links(per_fp.select("fp"))).withColumnRenamed("node", "fp")
    roots = per_fp.join(rooted, "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"),
                                      F.sum("n").alias("class_size"))
    return roots.select("fp", "root").join(named, "root").select("fp", "root", "component_id",
                                                              "class_size")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    size: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: doc_id, kept columns, fingerprint in hex, component_id,
    class_size, root (the class)."""
    found = materialize(fingerprints(docs, doc_id, text, size, keep), "simhash-docs")
    return (found.join(classes(found), "fp", "left")
            .select("doc_id", *keep, hex_of(F.col("fp")).alias("fingerprint"), "component_id",
                    "class_size", "root"))
