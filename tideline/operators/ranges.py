"""Range joins on integer positions by equal buckets, so that they are hash joins and not loops over all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(intervals: DataFrame, points: DataFrame, start: str, end: str, at: str, by: Sequence[str], width: int) -> DataFrame:
    """Rows of intervals with every point of the same key with start <= at <= end. Intervals about ``width`` long meet two or three buckets.

    ``points`` must share no column names with ``intervals`` but the keys.
    """
    spread = intervals.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor({start} / {width}) as bigint), cast(floor({end} / {width}) as bigint))")))
    held = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    return spread.join(held, [*by, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals share a point."""
    return (a0 <= b1) & (a1 >= b0)
