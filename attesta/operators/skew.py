"""Ordered per-key work that does not need a whole key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import materialize


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                   value: str, out: str) -> DataFrame:
    """`lag(value)` per key in `order`, for keys too large for one task.

    `chunk` cuts a key into consecutive ranges of `order` (a day of a timestamp, a range of an
    id). Rows are windowed inside (key, chunk); each chunk's first row takes the last value of
    the key's previous chunk from a table with one row per (key, chunk).
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk)
    place = F.struct(*order)
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max(F.struct(place.alias("_place"), F.col(value).alias("_value"))).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carried = tails.select(*keys, "_chunk", F.lag("_tail._value").over(across).alias("_carried"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    first = F.row_number().over(inside) == 1
    ranked = chunked.withColumn("_first", first).withColumn("_lag", F.lag(value).over(inside))
    joined = ranked.join(carried, [*keys, "_chunk"], "left")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(
        F.col("_lag"))).drop("_chunk", "_first", "_lag", "_carried")


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str = "row_no") -> DataFrame:
    """0-based position of every row in a total order, without a one-task window.

    Range-sorted rows are written once with (partition, offset) ids; partition sizes are then
    summed up, one row per partition, and added back.
    """
    placed = materialize(
        df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    offset_mask = (1 << 33) - 1
    parts = placed.withColumn("_part", F.shiftright("_id", 33))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0))
                          .alias("_start"))
    number = F.col("_start") + F.col("_id").bitwiseAND(offset_mask)
    return parts.join(starts, "_part").withColumn(out, number).drop("_part", "_start", "_id")
