"""Positions inside groups without a window over a whole group.

``row_number`` over a group brings all its rows into one task.  Here the rows are
dealt in ranges of (group, order), so that a large group lies in many ranges
one after another; a row's position is the number of its group's rows in the
ranges before plus its place in its own range.  The only window over a group
runs over its ranges' counts, of which there are as many as partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearhouse.plans.session import materialize


def dealt(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with the number of its range as ``_range``: written once into the
    shared checkpoint folder, so that all readers see the same ranges."""
    keys = [*(F.col(c) for c in group_cols), *order]
    spread = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return materialize(spread.withColumn("_range", F.spark_partition_id()))


def ranked_by_ranges(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], name: str, ranges: int | None = None) -> DataFrame:
    """Adds the 1-based position of each row inside its group under ``order``,
    which must be total.  Unlike ``topk.ranked`` this runs a job when it is built
    (the ranges are cut from the data), and no task holds more than a range."""
    rows = dealt(df, group_cols, order, ranges)
    counts = rows.groupBy(*group_cols, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # NULL groups are groups, too
    counts = counts.select("_before", F.col("_range").alias("_r"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group_cols):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy("_range", *group_cols).orderBy(*order))
    placed = rows.withColumn("_own", own).join(counts, same)
    return placed.select(*df.columns, (F.col("_before") + F.col("_own")).alias(name))
