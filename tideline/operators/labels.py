"""Event labels: volatility, CUSUM sampling, triple barriers, concurrency and sample weights.

Bars are long: (by..., idx, high, low, close[, sigma]), idx numbering the bars of a key from 0. CUSUM sampling, in which each
step needs the one before, runs per key over Arrow; all else is joins and windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import windows as W
from tideline.operators.ranges import interval_join

K_GRID = (0.5, 0.75, 1.0, 1.25, 1.5)
#: Columns of labelled events besides their keys.
FIELDS = ("t0_idx", "t1_idx", "label", "ret", "trgt", "touch", "t0_time", "t1_time", "uniqueness", "w_attrib", "w_decay", "sample_weight", "barrier_mult", "cusum_k")
#: Fewest and most events, over all keys, that a sampling threshold should give.
TARGET = (1500, 3200)


@dataclass(frozen=True)
class Barriers:
    """Multiples of the volatility target above and below, bars until the vertical barrier, its label ("sign" or "zero"), and the least target."""

    up: float = 1.5
    down: float = 1.5
    horizon: int = 120
    vertical: str = "sign"
    least: float = 1e-4


def numbered(bars: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Adds idx, the number of a bar within its key from 0."""
    return bars.withColumn("idx", F.row_number().over(W.series(by, at)).cast("long") - 1)


def with_volatility(bars: DataFrame, by: Sequence[str] = ("asset",), span_days: int = 100, min_days: int = 30, day: int = 24) -> DataFrame:
    """Adds sigma to numbered bars: the exponentially weighted deviation of day-long log returns up to a bar; null before min_days of them.

    The first return of a key stands for all that came before it, so it weighs 1 / alpha where others weigh 1; then mean and mean square are plain weighted
    means over the returns that are there, and a bar without a return keeps the deviation of the bar before.
    """
    w, alpha = W.series(by, "idx"), 2.0 / (span_days * day + 1)
    kept = bars.select(*by, "idx", "high", "low", "close", W.logret(F.col("close").cast("double"), day, w).alias("_r"))
    r, n = F.col("_r"), F.row_number().over(w)
    seen = kept.where(r.isNotNull() & ~F.isnan(r)).select(*by, F.col("idx").alias("_at"), r, n.alias("_k"))
    weight = F.when(F.col("_k") == 1, 1 / alpha).otherwise(1.0)
    seen = W.ewm(seen, {"_m": (r, alpha, weight), "_q": (r * r, alpha, weight)}, by, "_at")
    sigma = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    seen = seen.select(*[F.col(b).alias(f"_k_{b}") for b in by], "_at", F.when(F.col("_k") >= min_days * day, sigma).alias("_s"))
    meets = F.col("idx") == F.col("_at")
    for b in by:
        meets &= F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    held = kept.join(seen, meets, "left")
    return held.select(*by, "idx", "high", "low", "close", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sigma"))


def rises(steps: np.ndarray, level: np.ndarray, barred: np.ndarray) -> list[int]:
    """Places where the sum of steps stands at least ``level`` above its lowest point since the last such place; barred ones don't count.

    The height above the lowest point is a cumulative sum less its running minimum, so a stretch between two places is a few array operations. A
    missing step starts anew after it.
    """
    found: list[int] = []
    gaps = np.flatnonzero(np.isnan(steps))
    for first, last in zip([0, *(gaps + 1)], [*gaps, len(steps)], strict=True):
        at, height, size = first, 0.0, 64
        while at < last:
            part = slice(at, min(at + size, last))
            total = height + np.cumsum(steps[part])
            above = total - np.minimum(np.minimum.accumulate(total), 0.0)
            hits = np.flatnonzero((above >= level[part]) & ~barred[part])
            if len(hits):
                at, height, size = at + int(hits[0]) + 1, 0.0, 64
                found.append(at - 1)
            else:
                at, height, size = part.stop, above[-1], min(2 * size, 1 << 14)
    return found


def cusum(close: np.ndarray, threshold: np.ndarray) -> list[int]:
    """Bars where log returns have risen, or else fallen, by the bar's threshold since the lowest (highest) point after the last such bar of that side.

    A missing return starts both sides anew; at a missing threshold nothing can fire.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.diff(np.log(close))
    barred = np.zeros(len(steps), bool)
    up = rises(steps, threshold[1:], barred)
    barred[up] = True
    return sorted(t + 1 for t in [*up, *rises(-steps, threshold[1:], barred)])


def _key_schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"{b} {df.schema[b].dataType.simpleString()}, " for b in by)


def cusum_events(bars: DataFrame, k: Sequence[float], by: Sequence[str] = ("asset",)) -> DataFrame:
    """(by..., k, idx): sampled bars of numbered bars with sigma, for every threshold k * sigma at once. Where a side starts anew depends on all before it, so a key is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        close, sigma, idx = (pdf[c].to_numpy(float) for c in ("close", "sigma", "idx"))
        found = [(x, int(idx[t])) for x in k for t in cusum(close, x * sigma)]
        out = pd.DataFrame(found, columns=["k", "idx"]).astype({"k": "float64", "idx": "int64"})
        for i, b in enumerate(by):
            out.insert(i, b, pdf[b].iloc[0])
        return out

    return bars.select(*by, "idx", "close", "sigma").groupBy(*by).applyInPandas(run, _key_schema(bars, by) + "k double, idx long")


def triple_barrier(events: DataFrame, bars: DataFrame, cfg: Barriers, by: Sequence[str] = ("asset",), keep: Sequence[str] = ()) -> DataFrame:
    """(by, keep..., t0_idx, t1_idx, label, ret, trgt, touch) of events (by, idx[, side]) whose whole window was seen.

    Barriers stand around the close at t0; bars after it are scanned up to the horizon by high and low. A bar that touches both
    counts as touching the adverse one; a touch fills at the barrier. Events with a missing or small target, a window beyond the data,
    or a missing value inside are dropped. With a ``side`` column the barriers go with the side and the label says if it paid.
    """
    sided = "side" in events.columns
    fields = [*by, *keep]
    scale = math.sqrt(cfg.horizon / 24.0)
    at = events.select(*fields, F.col("idx").cast("long").alias("t0_idx"), (F.col("side").cast("double") if sided else F.lit(1.0)).alias("s"))
    own = bars.select(*by, F.col("idx").alias("t0_idx"), F.col("close").alias("p0"), (F.col("sigma") * scale).alias("trgt"))
    at = at.join(own, [*by, "t0_idx"]).where(F.col("trgt").isNotNull() & ~F.isnan("trgt") & (F.col("trgt") >= cfg.least))
    long = F.col("s") > 0
    at = at.withColumns({
        "up": F.col("p0") * (1 + F.when(long, cfg.up).otherwise(cfg.down) * F.col("trgt")),
        "dn": F.col("p0") * (1 - F.when(long, cfg.down).otherwise(cfg.up) * F.col("trgt")),
        "end": F.col("t0_idx") + cfg.horizon,
    })
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    scan = bars.select(*by, F.col("idx").alias("i"), "high", "low", "close", (finite("high") & finite("low") & finite("close")).alias("ok"))
    pairs = interval_join(at, scan, "t0_idx", "end", "i", by, cfg.horizon)
    after = F.col("i") > F.col("t0_idx")
    hit_up, hit_dn = after & (F.col("high") >= F.col("up")), after & (F.col("low") <= F.col("dn"))
    both = hit_up & hit_dn
    first = F.min(F.when(hit_up | hit_dn, F.struct("i", F.when(both, F.when(long, "down").otherwise("up")).when(hit_up, "up").otherwise("down").alias("touch"))))
    found = pairs.groupBy(*fields, "t0_idx", "s", "p0", "trgt", "up", "dn", "end").agg(
        first.alias("hit"), F.count_if("ok").alias("n"), F.max(F.when(F.col("i") == F.col("end"), F.col("close"))).alias("last")
    )
    found = found.where(F.col("n") == cfg.horizon + 1)
    touch = F.coalesce(F.col("hit")["touch"], F.lit("vertical"))
    level = F.when(touch == "up", F.col("up")).when(touch == "down", F.col("dn")).otherwise(F.col("last"))
    out = found.select(*fields, "t0_idx", F.coalesce(F.col("hit")["i"], F.col("end")).alias("t1_idx"), (level / F.col("p0") - 1.0).alias("ret"), "trgt", touch.alias("touch"), "s")
    if sided:
        adverse = F.when(F.col("s") > 0, "down").otherwise("up")
        label = ((F.col("ret") * F.col("s") > 0) & (F.col("touch") != adverse)).cast("int")
    else:
        label = F.when(F.col("touch") == "up", 1).when(F.col("touch") == "down", -1).otherwise(F.signum("ret").cast("int") if cfg.vertical == "sign" else 0)
    return out.select(*fields, "t0_idx", "t1_idx", label.alias("label"), "ret", "trgt", "touch")


def concurrency(events: DataFrame, bars: DataFrame, by: Sequence[str] = ("asset",), keep: Sequence[str] = ()) -> DataFrame:
    """(by, keep..., idx, c): how many windows [t0, t1] cover each bar, from +1 and -1 at their ends."""
    f = [*by, *keep]
    ends = events.select(*f, F.col("t0_idx").alias("idx"), F.lit(1).alias("d")).unionAll(events.select(*f, (F.col("t1_idx") + 1).alias("idx"), F.lit(-1).alias("d")))
    ends = ends.groupBy(*f, "idx").agg(F.sum("d").alias("d"))
    series_of = events.select(*f).distinct()
    every = bars.select(*by, "idx").join(series_of, [*by]) if by else bars.select("idx").crossJoin(F.broadcast(series_of)) if keep else bars.select("idx")
    w = Window.partitionBy(*f).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(ends, [*f, "idx"], "left").select(*f, "idx", F.sum(F.coalesce("d", F.lit(0))).over(w).alias("c"))


def sample_weights(events: DataFrame, bars: DataFrame, by: Sequence[str] = ("asset",), keep: Sequence[str] = (), last: float = 0.75, floor: float = 1e-3) -> DataFrame:
    """Adds uniqueness, w_attrib, w_decay and sample_weight, each series of events (by, keep) for itself.

    Uniqueness is the mean of 1/concurrency over the window; attribution the size of the window's return shared among concurrent ones, with mean 1;
    decay rises with cumulative uniqueness (by end, then start) from ``last`` to 1; weights are floored at a share of their mean.
    """
    f = [*by, *keep]
    w = W.series(by, "idx")
    r = F.coalesce(F.ln(F.col("close")) - F.lag(F.ln(F.col("close"))).over(w), F.lit(0.0))
    per_bar = concurrency(events, bars, by, keep).join(bars.select(*by, "idx", r.alias("r")), [*by, "idx"])
    per_bar = per_bar.select(*f, F.col("idx").alias("i"), F.greatest("c", F.lit(1)).alias("c"), "r")
    spans = interval_join(events.select(*f, "t0_idx", "t1_idx"), per_bar, "t0_idx", "t1_idx", "i", f, 128)
    raw = spans.groupBy(*f, "t0_idx", "t1_idx").agg(F.avg(1.0 / F.col("c")).alias("uniqueness"), F.abs(F.sum(F.col("r") / F.col("c"))).alias("_raw"))
    whole = Window.partitionBy(*f)
    so_far = whole.orderBy("t1_idx", "t0_idx").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("uniqueness").over(whole)
    slope = (1.0 - last) / total if last >= 0 else 1.0 / ((last + 1.0) * total)
    out = raw.withColumns({
        "w_attrib": F.col("_raw") * F.count("*").over(whole) / F.greatest(F.sum("_raw").over(whole), F.lit(1e-12)),
        "w_decay": F.greatest(1.0 - slope * total + slope * F.sum("uniqueness").over(so_far), F.lit(0.0)),
    }).withColumn("_w", F.col("w_attrib") * F.col("w_decay"))
    out = out.withColumn("sample_weight", F.greatest("_w", floor * F.avg("_w").over(whole))).drop("_raw", "_w")
    return events.join(out, [*f, "t0_idx", "t1_idx"])


def calibrated_k(bars: DataFrame, cfg: Barriers, by: Sequence[str] = ("asset",), grid: Sequence[float] = K_GRID, most: int = TARGET[1]) -> float:
    """The smallest threshold whose surviving events, over all keys, number at most ``most``; else the largest. All are counted in one job."""
    labelled = triple_barrier(cusum_events(bars, grid, by), bars, cfg, by, keep=["k"])
    counts = {r["k"]: r["n"] for r in labelled.groupBy("k").agg(F.count("*").alias("n")).collect()}
    return next((k for k in sorted(grid) if counts.get(k, 0) <= most), max(grid))


def generate(bars: DataFrame, cfg: Barriers, k: float | None = None, by: Sequence[str] = ("asset",), at: str = "open_time", until: object = None, **volatility) -> DataFrame:
    """Labels with weights and times, from raw bars (by, at, high, low, close); ``until`` cuts events off before weights are taken."""
    held = numbered(bars, by, at)
    vol = with_volatility(held, by, **volatility)
    k = calibrated_k(vol, cfg, by) if k is None else k
    times = held.select(*by, F.col("idx").alias("_i"), F.col(at).alias("_t"))
    named = lambda df, i, t: df.join(times.select(*by, F.col("_i").alias(i), F.col("_t").alias(t)), [*by, i])
    events = named(triple_barrier(cusum_events(vol, [k], by).drop("k"), vol, cfg, by), "t0_idx", "t0_time")
    if until is not None:
        events = events.where(F.col("t0_time") <= F.lit(until))
    out = named(sample_weights(events, vol, by), "t1_idx", "t1_time")
    return out.withColumns({"barrier_mult": F.lit(cfg.up), "cusum_k": F.lit(float(k))})


def variant_suffix(mult: float, default: float = 1.5) -> str:
    return "" if mult == default else f"_m{round(mult * 10)}"


def generate_variants(bars: DataFrame, base: DataFrame, mults: Sequence[float], cfg: Barriers, by: Sequence[str] = ("asset",), **volatility) -> dict[str, DataFrame]:
    """Label sets for other barrier multiples, by suffix: the default set's k and last event time, so that all sample the same events."""
    known = base.agg(F.first("cusum_k").alias("k"), F.max("t0_time").alias("until")).first()
    return {variant_suffix(m): generate(bars, Barriers(m, m, cfg.horizon, cfg.vertical, cfg.least), known["k"], by, until=known["until"], **volatility) for m in mults}


def summary(labels: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    side = lambda v: F.count_if(F.col("label") == v)
    touched = lambda v: F.count_if(F.col("touch") == v)
    return labels.groupBy(*by).agg(
        F.count("*").alias("events"), side(1).alias("up"), side(-1).alias("down"), side(0).alias("flat"), touched("up").alias("touch_up"), touched("down").alias("touch_down"),
        touched("vertical").alias("vertical"), F.round(F.avg("uniqueness"), 3).alias("mean_uniqueness"), F.min("t0_time").alias("first"), F.max("t0_time").alias("last"),
    )
