"""Session settings and the shared work folder.

Nothing here picks a physical strategy by hand: broadcast joins are left to Spark's own
size checks (`autoBroadcastJoinThreshold`, adaptive re-planning), so no side is ever
broadcast without its size having been measured.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings every plan in this package assumes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Small shuffles may still feed costly rows; keep cores busy. Large ones are not affected.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    # Split a skewed join side even where that costs one more shuffle above it.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # Rows are whole texts and pages: a Python worker holds so many of them at a time.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def work_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a local-mode session without that setting (tests) gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    own = spark.conf.get("attesta.work.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="attesta-")
    spark.conf.set("attesta.work.dir", own)
    return own


def work_path(spark: SparkSession, label: str) -> str:
    path = f"{work_root(spark)}/attesta/{label}-{uuid.uuid4().hex}"
    for made in getattr(_scratch, "made", ()):
        made.append(path)
    return path


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end. For work whose results are written
    by then, such as a micro-batch: frames that still read them cannot be used afterwards."""
    made: list[str] = []
    stack = _scratch.__dict__.setdefault("made", [])
    stack.append(made)
    try:
        yield
    finally:
        stack.pop()
        for path in made:
            remove(spark, path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders inside a folder, in whatever store its path names; none if missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(hadoop):
        return []
    return [s.getPath().getName() for s in store.listStatus(hadoop) if s.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library in whatever store its path names; a missing one is fine."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and scanning it back.

    Survives executor loss, and the scan carries file sizes the planner can use.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
