"""What the operators of this package share: words, Arrow helpers and row keys."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.session import materialize

#: A word, as a Java and Python pattern: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts per Arrow batch. Texts are whole, so a batch is bounded by rows here and by
#: Spark's own byte bound where it has one.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the folder; Spark reads it, so any store that Spark knows will do."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8. `bytes.split()` splits at 0x20 and 0x09-0x0D, and at nothing else."""
    return text.encode("utf-8", "replace").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z, and only those, in lower case (`bytes.lower` knows ASCII alone)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def map_arrow(df: DataFrame, columns: list[Column | str],
              work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """`mapInArrow` over just the columns that the work reads."""
    return df.select(*columns).mapInArrow(work, schema)


def aside(df: DataFrame, keep: tuple[str, ...]) -> tuple[list[Column], list[str], str, list[Column]]:
    """Carry columns of any name, dots and clashes included, through a task function: the columns
    under plain names, these names, their schema, and the columns under their own names again."""
    plain = [f"kept_{i}" for i in range(len(keep))]
    types = "".join(f"{p} {df.schema[k].dataType.simpleString()}, " for p, k in zip(plain, keep))
    return ([F.col(f"`{k}`").alias(p) for p, k in zip(plain, keep)], plain, types,
            [F.col(p).alias(k) for p, k in zip(plain, keep)])


def sent(spark: SparkSession, thing: Any) -> Callable[[], Any]:
    """Send a value to all tasks once; calling the result in a task gives it back.

    It travels as bytes that hold its class as well, so workers that cannot import this package
    can read it, which a plain broadcast of an object of ours would need.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: cloudpickle.loads(held.value)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, lengthened until no column of the frame has that name (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder, read it back, and let go of its shuffle files.

    Spark deletes the shuffle files of a finished step when the driver's JVM collects what
    pointed to them. Between large steps that is worth asking for, as disks would otherwise
    hold the shuffles of all steps at once.
    """
    spark = df.sparkSession
    out = materialize(df, label)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out
