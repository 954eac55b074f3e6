"""Exact global order without a global sort in one task.

Rows are range-partitioned by the order and sorted within partitions.  A row's ordinal in its partition is read off
``monotonically_increasing_id``; counts per partition, at most one row for each partition, give the offsets as prefix sums.
The ranges come from a sample, so outliers, nulls and ties do no harm: equal values are split by the row id, and rows
equal in both by a random third key.  The ranged rows are fixed once (``session.cut_lineage``), because counts and
ordinals must come from the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriledger.session import cut_lineage

_PART_BITS = 33  # monotonically_increasing_id keeps the row's ordinal in its lower 33 bits


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in range partitions of ``order``, with ``_part`` and ``_at``, the ordinal from 0 within it."""
    tied = df.withColumn("_tie", F.rand(7))
    placed = tied.repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", _PART_BITS).cast("int")
    return cut_lineage(placed.withColumns({"_part": part, "_at": F.col("_id").bitwiseAND(F.lit((1 << _PART_BITS) - 1))}).drop("_id"))


def ordinals(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """1-based position of every row in ``order``; rows equal in all of it get positions next to each other."""
    placed = ranged(df, *order)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_at") + 1).cast("long").alias(out))


def global_rank(df: DataFrame, value: str, row_id: str, out: str = "rank") -> DataFrame:
    """1-based position of every row by ``value`` descending (null last), then ``row_id`` ascending (null first)."""
    return ordinals(df, F.desc_nulls_last(value), F.asc_nulls_first(row_id), out=out)


def carried(df: DataFrame, *order: Column, value: str, out: str) -> DataFrame:
    """``df`` with the last non-null ``value`` of the rows before each in ``order`` (null where there is none).

    Within a partition an ordered window finds it; what a partition leaves behind is carried to the next ones over
    one row for each partition.
    """
    placed = ranged(df, *order)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    left = placed.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, "_at").alias("_left"))
    parts = placed.select("_part").distinct().join(left, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    brought = parts.select("_part", F.last("_left", ignorenulls=True).over(before).alias("_brought"))
    near = placed.withColumn("_near", F.last(value, ignorenulls=True).over(inside))
    return near.join(brought, "_part").select(*df.columns, F.coalesce("_near", "_brought").alias(out))
