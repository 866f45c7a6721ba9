"""Probability of backtest overfitting by combinatorially symmetric cross-validation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_moments(returns: DataFrame, blocks: int, t: str = "t", trial: str = "trial", r: str = "r") -> DataFrame:
    """(block, trial, n, s, q): count, sum and sum of squares of each trial in contiguous, even blocks of time. All later steps work on these few rows.

    The distinct times (days, mostly) are numbered in one task; whether they or the moments are broadcast is left to their size.
    """
    times = returns.select(t).distinct().withColumn("block", F.ntile(blocks).over(Window.orderBy(t)) - 1)
    return returns.join(times, t).groupBy("block", F.col(trial).alias("trial")).agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(F.col(r) * F.col(r)).alias("q"))


def partitions(returns: DataFrame, blocks: int = 16, **columns: str) -> DataFrame:
    """(part, trial, omega, logit): for each choice of half the blocks the trial best inside and its relative midrank outside."""
    if blocks % 2:
        raise ValueError("the number of blocks must be even")
    spark = returns.sparkSession
    rows = [(i, b, int(b in c)) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    choice = spark.createDataFrame(rows, "part int, block int, inside int")  # C(blocks, blocks / 2) * blocks rows
    sums = choice.join(block_moments(returns, blocks, **columns), "block").groupBy("part", "trial", "inside").agg(*[F.sum(c).alias(c) for c in "nsq"])
    var = F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))
    sr = F.when(var > 1e-18, F.col("s") / F.col("n") / F.sqrt(var)).otherwise(F.lit(0.0))
    # equal trials must tie although their sums may differ in the last bits
    wide = sums.select("part", "trial", "inside", F.round(sr, 12).alias("sr")).groupBy("part", "trial").pivot("inside", [0, 1]).agg(F.first("sr"))
    w = Window.partitionBy("part")
    ranked = wide.withColumns({
        "rank": F.rank().over(w.orderBy("0")) + (F.count("*").over(Window.partitionBy("part", "0")) - 1) / F.lit(2.0),
        "trials": F.count("*").over(w),
        "best": F.row_number().over(w.orderBy(F.desc("1"), "trial")),
    })
    omega = F.col("rank") / (F.col("trials") + 1)
    return ranked.where("best = 1").select("part", "trial", omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"))


def pbo(returns: DataFrame, blocks: int = 16, **columns: str) -> DataFrame:
    """(pbo, n_partitions, mean_logit)."""
    return partitions(returns, blocks, **columns).agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("n_partitions"), F.avg("logit").alias("mean_logit"))
