"""Versioned tables in buckets: a run rewrites only the buckets that it touches.

Plain Parquet has no MERGE. A table's rows are dealt to a fixed number of buckets by a hash of its
keys. The next state is written beside the old one, but only for the buckets that hold a changed
key. A row in the `versions` log makes it the current one, and names for every bucket the version
whose folder holds it, so readers see all of a version or none. Old versions stay readable until
they are retired; bucket folders that no remaining version names then go.

A table without keys is one bucket and is written whole.

    <path>/data/v00000007/_bucket=12/   rows
    <path>/versions/                    committed versions: buckets, schema, place of each bucket
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.session import folders, remove

#: Buckets of a new table with keys; a table keeps the number it was made with. Up to this many
#: folders Spark lists on the driver; a table whose buckets grow beyond a few GB wants more.
BUCKETS = 32

_LOG = "version long, written long, buckets int, schema string, places map<int,long>"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    if not keys or buckets == 1:
        return F.lit(0)
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _log(spark: SparkSession, path: str, kept: Column | None = None, newest: int = 1) -> list[Row]:
    """The newest rows of the log, one per version, newest first. A version that was written
    again counts as it was written last."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{path}/versions")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    if kept is not None:
        log = log.filter(kept)
    order = [F.desc("version"), F.desc("written")]
    if newest == 1:
        return log.orderBy(*order).limit(1).collect()
    last = log.groupBy("version").agg(F.max_by("places", "written").alias("places"))
    return last.orderBy(F.desc("version")).limit(newest).collect()


def _head(spark: SparkSession, path: str, below: int | None = None,
          version: int | None = None) -> Row | None:
    """The log's row of a version: the newest, the newest before `below`, or the given one."""
    kept = None
    if version is not None:
        kept = F.col("version") == version
    elif below is not None:
        kept = F.col("version") < below
    found = _log(spark, path, kept)
    return found[0] if found else None


def current_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """Newest committed version, or the newest before `below`."""
    head = _head(spark, path, below)
    return None if head is None else head["version"]


def touched_buckets(df: DataFrame, path: str, keys: Sequence[str],
                    buckets: int = BUCKETS) -> list[int]:
    """Buckets that the keys of a frame fall into: at most as many as the table has."""
    head = _head(df.sparkSession, path)
    bucket = _bucket(keys, head["buckets"] if head else buckets)
    return sorted(r[0] for r in df.select(bucket).distinct().collect())


def read_version(spark: SparkSession, path: str, version: int | None = None,
                 below: int | None = None, only: Iterable[int] | None = None) -> DataFrame | None:
    """A version's rows, or those of some of its buckets; None if there is no such version."""
    head = _head(spark, path, below, version)
    if head is None:
        return None
    schema, places = T.StructType.fromJson(json.loads(head["schema"])), head["places"]
    chosen = sorted(places if only is None else {b for b in only if b in places})
    paths = [f"{path}/data/v{places[b]:08d}/_bucket={b}" for b in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_version(df: DataFrame, path: str, cluster_by: Sequence[str] = (),
                  version: int | None = None, keys: Sequence[str] = (),
                  only: Iterable[int] | None = None, buckets: int = BUCKETS) -> int:
    """Write the next state, or the given version: a stream batch that is delivered again writes
    its own version again, from the version before it.

    With `only`, `df` need hold no other buckets than these: all others stay as they are in the
    version before. A bucket of `only` without rows is empty from then on.
    """
    spark = df.sparkSession
    before = _head(spark, path, version)
    number = version if version is not None else (before["version"] + 1 if before else 1)
    if before is not None:
        buckets = before["buckets"]
    elif not keys:
        buckets = 1
    chosen = None if only is None else sorted(set(only))
    rows = df.withColumn("_bucket", _bucket(keys, buckets))
    if chosen is not None:
        rows = rows.filter(F.col("_bucket").isin(chosen))
    if cluster_by:
        # Files of a bucket hold ranges that do not overlap, so a reader of a range skips files.
        rows = rows.repartitionByRange("_bucket", *cluster_by).sortWithinPartitions(
            "_bucket", *cluster_by)
    elif buckets > 1:
        rows = rows.hint("rebalance", "_bucket")  # a large bucket is several tasks and files
    rows.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v{number:08d}")
    places = {b: number for b in _buckets_in(spark, path, number)}
    if chosen is not None and before is not None:
        places = {b: v for b, v in before["places"].items() if b not in chosen} | places
    spark.createDataFrame([(number, time.time_ns(), buckets, df.schema.json(), places)], _LOG).coalesce(
        1).write.mode("append").parquet(f"{path}/versions")
    return number


def _buckets_in(spark: SparkSession, path: str, version: int) -> list[int]:
    return [int(name.removeprefix("_bucket=")) for name in folders(
        spark, f"{path}/data/v{version:08d}") if name.startswith("_bucket=")]


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[tuple[int, int]]:
    """Keep the newest versions readable, and delete bucket folders that none of them names:
    returned as (version that wrote it, bucket).

    The newest two must stay, as a batch that is delivered again starts from the one before it.
    Versions that are being written, which are newer than all of these, are left alone.
    """
    kept = _log(spark, path, newest=max(2, keep))
    if not kept:
        return []
    named = {(v, b) for row in kept for b, v in row["places"].items()}
    gone = []
    for name in folders(spark, f"{path}/data"):
        written = int(name.removeprefix("v"))
        if written > kept[0]["version"]:
            continue
        held = _buckets_in(spark, path, written)
        unnamed = [(written, b) for b in held if (written, b) not in named]
        for _, bucket in unnamed:
            remove(spark, f"{path}/data/{name}/_bucket={bucket}")
        if len(unnamed) == len(held) and written < kept[-1]["version"]:
            remove(spark, f"{path}/data/{name}")
        gone += unnamed
    return gone
