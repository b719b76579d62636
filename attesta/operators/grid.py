"""A two-sided block grid: all rows of one frame meet all rows of another inside tasks.

Both sides are cut into blocks of bounded size where they are scanned; a block is one row. Every
pair of blocks meets in one call of a function over two Arrow tables, which returns what is worth
keeping (usually the best few per left row), so no pair of rows is ever a row of a shuffle.

Neither side is collected or broadcast, and the plan is the same for ten rows and for ten million.
Blocks are dealt to stripes, left blocks are repeated per right stripe and right blocks per left
stripe: the copies of a side grow with the square root of the number of cells that the work needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import materialize

#: Rows of a block. Rows are expected to be small: ids, vectors, sets.
BLOCK_ROWS = 4096
#: Pairs of blocks handed to a task's Python at a time.
CELLS_AT_ONCE = 4
#: Pairs of blocks a cell may hold beyond what keeps the cluster busy.
CELL_PAIRS = 16

Kernel = Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside hand so many rows at a time to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def blocks(df: DataFrame, rows: int) -> DataFrame:
    """(part, body): rows of a frame in blocks of at most so many, in Arrow's own format."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for piece in held:
                    writer.write_batch(piece)
            return pa.RecordBatch.from_arrays(
                [pa.array([sink.getvalue().to_pybytes()])], names=["body"])

        held, size = [], 0
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                piece = batch.slice(begin, rows)
                if held and size + piece.num_rows > rows:
                    yield block(held)
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield block(held)

    return df.mapInArrow(pack, "body binary").withColumn("part", F.monotonically_increasing_id())


def _stripes(left: int, right: int, cores: int) -> tuple[int, int]:
    """How many stripes each side is dealt to: enough cells for the cluster and to keep a cell
    small, with each side copied no more often than it must be."""
    cells = min(left * right, max(4 * cores, -(-left * right // CELL_PAIRS)))
    on_left = max(1, min(left, isqrt(cells * left // max(1, right))))
    return on_left, max(1, min(right, -(-cells // on_left)))


def meet(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str,
         left_rows: int | None = None, right_rows: int | None = None) -> DataFrame:
    """What `kernel(left block, right block)` yields over all pairs of blocks.

    An empty side gives no rows. Runs jobs while the frame is built; the result is written to the
    shared folder, so that no later step repeats a cell.
    """
    spark = left.sparkSession
    left = materialize(blocks(left, left_rows or BLOCK_ROWS), "grid-left")
    right = materialize(blocks(right, right_rows or BLOCK_ROWS), "grid-right")
    on_left, on_right = _stripes(left.count(), right.count(),
                                 spark.sparkContext.defaultParallelism)

    def dealt(stripes: int) -> Column:
        return F.pmod(F.xxhash64("part"), F.lit(stripes)).cast("int")

    def every(stripes: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))

    cells = (left.select(dealt(on_left).alias("i"), every(on_right).alias("j"),
                         F.col("body").alias("left_body"))
             .join(right.select(every(on_left).alias("i"), dealt(on_right).alias("j"),
                                F.col("body").alias("right_body")), ["i", "j"])
             .select("left_body", "right_body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from kernel(*(pa.ipc.open_stream(c[k].as_buffer()).read_all()
                                    .combine_chunks() for c in batch.columns))

    with batches_of(spark, CELLS_AT_ONCE):
        return materialize(cells.mapInArrow(run, schema), "grid-met")
