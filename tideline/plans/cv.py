"""Purged cross-validation over labelled events (id, t0, t1)."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ranges import overlaps

EMBARGO = "interval 22 days"


def groups(events: DataFrame, n: int, t0: str = "t0", key: str = "id") -> DataFrame:
    """Adds fold, 0 to n - 1: contiguous and as even as can be in order of t0.

    Ranks are counts of the days before plus ranks within a day, so no task sorts all events: one row a day meets in the only window over all.
    """
    dated = events.withColumn("_day", F.to_date(t0))
    days = dated.groupBy("_day").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_k")
    starts = days.select(F.col("_day").alias("_d"), before.alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    at = F.row_number().over(Window.partitionBy("_day").orderBy(t0, key)) - 1
    placed = dated.withColumn("_at", at).join(starts, F.col("_day").eqNullSafe(F.col("_d"))).withColumn("_rank", F.col("_before") + F.col("_at"))
    # the first (total mod n) folds hold one event more
    small, more = F.expr(f"_n div {n}"), F.col("_n") % n
    edge = more * (small + 1)
    fold = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (small + 1))).otherwise(more + F.floor((F.col("_rank") - edge) / F.greatest(small, F.lit(1))))
    return placed.withColumn("fold", fold.cast("int")).drop("_at", "_day", "_d", "_before", "_n", "_rank")


def envelopes(folded: DataFrame, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """(fold, start, end): a row a fold."""
    return folded.groupBy("fold").agg(F.min(t0).alias("start"), F.max(t1).alias("end"))


def purged_kfold(events: DataFrame, n: int = 5, embargo: str = EMBARGO, t0: str = "t0", t1: str = "t1", key: str = "id") -> DataFrame:
    """(split, id, role): each event is test in its own fold's split, and train in others where its window neither
    overlaps that fold's nor starts in the embargo after it."""
    folded = groups(events, n, t0, key).select(key, t0, t1, "fold")
    tests = envelopes(folded, t0, t1).withColumnRenamed("fold", "split")
    pairs = folded.join(F.broadcast(tests))  # n rows
    unsafe = overlaps(F.col(t0), F.col(t1), F.col("start"), F.col("end")) | ((F.col(t0) > F.col("end")) & (F.col(t0) <= F.col("end") + F.expr(embargo)))
    role = F.when(F.col("fold") == F.col("split"), "test").when(~unsafe, "train")
    return pairs.select("split", key, role.alias("role")).where("role is not null")


def cpcv(events: DataFrame, n: int = 6, k: int = 2, embargo: str = EMBARGO, t0: str = "t0", t1: str = "t1", key: str = "id") -> DataFrame:
    """(split, id, role) of combinatorial purged cross-validation: k of n groups are tests, purged against each of them."""
    folded = groups(events, n, t0, key).select(key, t0, t1, "fold")
    spark = events.sparkSession
    table = spark.createDataFrame([(s, g) for s, c in enumerate(combinations(range(n), k)) for g in c], "split int, fold int")
    tests = table.join(envelopes(folded, t0, t1), "fold").select("split", F.col("fold").alias("of"), "start", "end")
    pairs = folded.join(F.broadcast(tests))  # C(n, k) * k rows
    unsafe = overlaps(F.col(t0), F.col(t1), F.col("start"), F.col("end")) | ((F.col(t0) > F.col("end")) & (F.col(t0) <= F.col("end") + F.expr(embargo)))
    one = pairs.groupBy("split", key).agg(F.bool_or(F.col("fold") == F.col("of")).alias("test"), F.bool_or(unsafe).alias("bad"))
    return one.select("split", key, F.when(F.col("test"), "test").when(~F.col("bad"), "train").alias("role")).where("role is not null")


def n_paths(n: int = 6, k: int = 2) -> int:
    return comb(n, k) * k // n


def path_map(n: int = 6, k: int = 2) -> list[list[int]]:
    """By group, the split whose test covers it in each path: the i-th split that tests a group belongs to path i."""
    return [[s for s, c in enumerate(combinations(range(n), k)) if g in c] for g in range(n)]
