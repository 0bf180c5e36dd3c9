"""Per-group top-k with a total order.

``row_number() <= k`` over ``Window.partitionBy(group)`` is planned by Spark as a
``WindowGroupLimit`` (Partial before the shuffle, Final after it): each map
task keeps at most k rows per group, so a group holding a third of all rows
still ships only ``k * map tasks`` rows to its reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` (which must be total)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    name = rank_col or "_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank_col else out.drop(name)


def ranked(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based position of each row inside its group (no limit).

    Only used on already-reduced inputs (aggregates or top-k results), whose
    groups are small.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group_cols).orderBy(*order)))
