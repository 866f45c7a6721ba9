"""Window columns over ordered series: full-window rolling statistics, exponentially weighted means, runs, ranks, calendars.

A rolling statistic is null until its window holds as many non-null values as it is long. All windows are partitioned
by the series' key, so that series spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

EPS = 1e-12


def series(by: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The current row and n - 1 before it."""
    return w.rowsBetween(-(n - 1), 0)


def full(x: Column, n: int, w: WindowSpec, agg: Callable[[Column], Column]) -> Column:
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling_mean(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.avg)


def rolling_std(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.stddev_samp)


def rolling_sum(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.sum)


def rolling_max(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, F.max)


def rolling_median(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, n, w, lambda c: F.percentile(c, 0.5))


def rolling_quantile_nearest(x: Column, q: float, n: int, w: WindowSpec) -> Column:
    """The value nearest to quantile q of the window, without interpolation."""
    return F.element_at(F.sort_array(full(x, n, w, F.collect_list)), math.floor(q * (n - 1) + 0.5) + 1)


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    return (x - rolling_mean(x, n, w)) / (rolling_std(x, n, w) + EPS)


def logret(x: Column, h: int, w: WindowSpec) -> Column:
    return F.ln(x / F.nullif(F.lag(x, h).over(w), F.lit(0.0)))


def clip_low(x: Column, low: float) -> Column:
    """Unlike greatest(), keeps null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def alpha_of(half_life: float | None = None, span: float | None = None, alpha: float | None = None) -> float:
    if half_life is not None:
        return 1 - math.exp(-math.log(2) / half_life)
    return 2 / (span + 1) if span is not None else float(alpha)


def ewm(df: DataFrame, columns: dict[str, tuple], by: Sequence[str], order: str, min_samples: int = 1) -> DataFrame:
    """Adds exponentially weighted means: name -> (value, alpha[, weight]), weights (1 - alpha)^age times the row's own over the sum of weights of non-null values.

    Null where the value is null. Rows are numbered and weighed within chunks, with sums running inside a chunk. A chunk is short enough
    that weights don't overflow, and long enough that what lies two chunks back weighs less than a double can tell, so
    only the sums of the chunk before are carried: any length will do. Columns whose weights fall at like rates share chunks, and so windows.
    """
    w = series(by, order)
    groups: list[list[tuple[str, Column, float]]] = []
    own = {name: c[2] for name, c in columns.items() if len(c) > 2}
    for name, (x, alpha, *_) in sorted(columns.items(), key=lambda c: c[1][1]):
        decay = -math.log(1 - alpha)
        if groups and 40 / groups[-1][0][2] <= 600 / decay:
            groups[-1].append((name, x, decay))
        else:
            groups.append([(name, x, decay)])
    out = df.withColumn("_i", F.row_number().over(w) - 1)
    drop = ["_i"]
    for g, members in enumerate(groups):
        size = max(2, math.floor(600 / members[-1][2]))
        c, j = f"_c{g}", f"_j{g}"
        out = out.withColumns({c: F.expr(f"_i div {size}"), j: F.col("_i") % size} | {f"_v_{n}": x for n, x, _ in members} | {f"_w_{n}": own[n] for n, _, _ in members if n in own})
        inside = series([*by, c], "_i").rowsBetween(Window.unboundedPreceding, 0)
        sums = {}
        for n, _, decay in members:
            up = F.when(F.col(f"_v_{n}").isNotNull(), F.exp(F.col(j) * decay) * (F.col(f"_w_{n}") if n in own else F.lit(1.0)))
            sums[f"_n_{n}"] = F.coalesce(F.sum(F.col(f"_v_{n}") * up).over(inside), F.lit(0.0)) * F.exp(F.col(j) * -decay)
            sums[f"_d_{n}"] = F.coalesce(F.sum(up).over(inside), F.lit(0.0)) * F.exp(F.col(j) * -decay)
        if min_samples > 1:
            sums |= {f"_s_{n}": F.count(f"_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, _, _ in members}
        out = out.withColumns(sums)
        # the last sums of the chunk before, aged by the rows since
        last = F.max(F.struct("_i", *[f"{k}_{n}" for n, _, _ in members for k in ("_n", "_d")])).over(Window.partitionBy(*by).orderBy(c).rangeBetween(-1, -1))
        out = out.withColumn(f"_b{g}", last)
        made = {}
        for n, _, decay in members:
            age = F.exp((F.col(j) + 1) * -decay)
            num, den = (F.col(f"{k}_{n}") + F.coalesce(F.col(f"_b{g}")[f"{k}_{n}"] * age, F.lit(0.0)) for k in ("_n", "_d"))
            there = F.col(f"_v_{n}").isNotNull()
            made[n] = F.when(there & (F.col(f"_s_{n}") >= min_samples) if min_samples > 1 else there, num / den)
        out = out.withColumns(made)
        drop += [c, j, f"_b{g}", *[f"{k}_{n}" for n, _, _ in members for k in ("_v", "_w", "_n", "_d", "_s")]]
    return out.drop(*drop)


def islands(df: DataFrame, value: str, by: Sequence[str], order: str) -> DataFrame:
    """Adds ``run``, the number of the run of equal values a row belongs to, and ``run_length``."""
    w = series(by, order)
    starts = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = df.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*by, "run")))


def midrank(x: str, by: Sequence[str] = ()) -> Column:
    """Rank from 1, ties averaged; nulls rank first, as rank() has them."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def densify(df: DataFrame, day: str, by: Sequence[str] = (), fill: dict[str, object] | None = None) -> DataFrame:
    """A row for every day between the first and last of each key; missing ones have nulls, or the values in ``fill``."""
    ends = df.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = ends.where("_a is not null").select(*by, F.explode(F.expr("sequence(_a, _b, interval 1 day)")).alias(day))
    out = days.join(df, [*by, day], "left")
    return out.fillna(fill) if fill else out


def drawdown(equity: Column, w: WindowSpec) -> Column:
    """1 - value over its running maximum."""
    return 1 - equity / F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))


def cumulative_product(growth: Column, w: WindowSpec) -> Column:
    """Of factors above zero."""
    return F.exp(F.sum(F.ln(growth)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def expanding_quantile(x: Column, q: float, w: WindowSpec) -> Column:
    return F.percentile(x, q).over(w.rowsBetween(Window.unboundedPreceding, 0))


def gaps(df: DataFrame, at: str, by: Sequence[str], minutes: int) -> DataFrame:
    """Neighbouring rows farther apart than ``minutes``: (by, gap_start, gap_end, gap_minutes)."""
    before = df.select(*by, F.lag(at).over(series(by, at)).alias("gap_start"), F.col(at).alias("gap_end"))
    apart = F.timestamp_diff("MINUTE", F.col("gap_start"), F.col("gap_end"))
    return before.withColumn("gap_minutes", apart).where(F.col("gap_minutes") > minutes)
