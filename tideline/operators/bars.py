"""Bars: resampling, and price, volatility and derivatives features on daily bars, one row per key and day.

Inputs are long: any number of series, told apart by ``by``. Every window ends at the current row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import windows as W

LN2 = math.log(2.0)
EPS = W.EPS
#: Columns that bars add up, and all that daily bars have besides their key and day.
SUMS = ("volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")
RAW = ("open", "high", "low", "close", *SUMS, "n_bars", "incomplete_day")
MOMENTUM = (1, 2, 5, 10, 21, 63, 126, 252)


def day_of(t: Column) -> Column:
    return F.date_trunc("day", t).cast("timestamp_ntz")


def to_daily(bars: DataFrame, by: Sequence[str] = ("asset",), at: str = "open_time", tie: str | None = None) -> DataFrame:
    """Daily bars from hourly ones: open and close by time, n_bars, and incomplete_day for fewer than 24. Days without bars are absent."""
    order = F.struct(at, tie) if tie else F.col(at)
    sums = [c for c in SUMS if c in bars.columns]
    out = bars.groupBy(*by, day_of(F.col(at)).alias("date")).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        *[F.coalesce(F.sum(c), F.lit(0).cast(bars.schema[c].dataType)).alias(c) for c in sums], F.count("*").alias("n_bars"),
    )
    return out.withColumn("incomplete_day", F.col("n_bars") < 24)


def realized_from_intraday(bars: DataFrame, by: Sequence[str] = ("asset",), at: str = "open_time") -> DataFrame:
    """Daily realised volatility: square root of the sum of squared log returns between neighbouring bars."""
    r = W.logret(F.col("close"), 1, W.series(by, at))
    days = bars.select(*by, day_of(F.col(at)).alias("date"), r.alias("_r"))
    return days.groupBy(*by, "date").agg(F.sqrt(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0))).alias("vol_realized_1d"))


def parkinson(n: int, w) -> Column:
    hl = F.ln(F.col("high") / F.col("low"))
    return F.sqrt(W.rolling_mean(hl * hl, n, w) / (4 * LN2))


def garman_klass(n: int, w) -> Column:
    hl, co = F.ln(F.col("high") / F.col("low")), F.ln(F.col("close") / F.col("open"))
    return F.sqrt(W.clip_low(W.rolling_mean(0.5 * hl * hl - (2 * LN2 - 1) * co * co, n, w), 0.0))


def ewma_vol(daily: DataFrame, half_lives: Sequence[int], by: Sequence[str] = ("asset",), order: str = "date") -> DataFrame:
    """Adds vol_ewma_{h}d: root of the exponentially weighted mean of squared daily log returns."""
    w = W.series(by, order)
    r = W.logret(F.col("close"), 1, w)
    out = daily.withColumn("_r", r)
    out = W.ewm(out, {f"_e{h}": (F.col("_r") * F.col("_r"), W.alpha_of(half_life=h)) for h in half_lives}, by, order)
    return out.withColumns({f"vol_ewma_{h}d": F.sqrt(f"_e{h}") for h in half_lives}).drop("_r", *[f"_e{h}" for h in half_lives])


def price_features(daily: DataFrame, by: Sequence[str] = ("asset",), order: str = "date") -> DataFrame:
    """Adds the price block: momentum, RSI, MACD, bands, trend, range, volatility and volume features, and vol_ewma_21d."""
    w = W.series(by, order)
    c, h, lo, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    out = daily.withColumns({"_r": W.logret(c, 1, w), "_d": c - F.lag(c).over(w)})
    means = {f"_g{n}": (W.clip_low(F.col("_d"), 0.0), 1 / n) for n in (7, 14, 30)}
    means |= {f"_s{n}": (W.clip_low(-F.col("_d"), 0.0), 1 / n) for n in (7, 14, 30)}
    means |= {"_m12": (c, W.alpha_of(span=12)), "_m26": (c, W.alpha_of(span=26))}
    means |= {f"_e{n}": (F.col("_r") * F.col("_r"), W.alpha_of(half_life=n)) for n in (5, 21, 63)}
    out = W.ewm(out, means, by, order).withColumns({f"vol_ewma_{n}d": F.sqrt(f"_e{n}") for n in (5, 21, 63)})
    out = W.ewm(out.withColumn("_macd", F.col("_m12") - F.col("_m26")), {"_signal": (F.col("_macd"), W.alpha_of(span=9))}, by, order)
    sigma = F.col("vol_ewma_21d")
    new: dict[str, Column] = {}
    for n in MOMENTUM:
        new[f"ret_{n}d"] = W.logret(c, n, w)
        new[f"mom_voladj_{n}d"] = W.logret(c, n, w) / F.nullif(sigma * n**0.5, F.lit(0.0))
    for n in (7, 14, 30):
        new[f"rsi_{n}"] = 100 - 100 / (1 + F.col(f"_g{n}") / (F.col(f"_s{n}") + EPS))
    new["macd_hist_norm"] = (F.col("_macd") - F.col("_signal")) / c
    ma, sd = W.rolling_mean(c, 20, w), W.rolling_std(c, 20, w)
    new["bb_pctb"] = (c - (ma - 2 * sd)) / (4 * sd + EPS)
    new["bb_bandwidth"] = 4 * sd / (ma + EPS)
    for n in (50, 200):
        new[f"px_vs_ma{n}"] = c / W.rolling_mean(c, n, w) - 1
    new["drawdown_252d"] = c / W.rolling_max(c, 252, w) - 1
    new["close_in_range"] = (c - lo) / (h - lo + EPS)
    new["range_1d"] = F.ln(h / lo)
    new["vol_parkinson_21d"], new["vol_gk_21d"] = parkinson(21, w), garman_klass(21, w)
    new["vol_ratio_5_63"] = F.col("vol_ewma_5d") / (F.col("vol_ewma_63d") + EPS)
    new["vol_of_vol_21d"] = W.rolling_std(sigma, 21, w)
    new["vol_z_252d"] = W.zscore(sigma, 252, w)
    new["volume_z_21d"] = W.zscore(v, 21, w)
    imbalance = (2 * F.col("taker_buy_base") - v) / (v + EPS)
    new["taker_imbalance"] = imbalance
    new["taker_imbalance_5d"] = W.rolling_mean(imbalance, 5, w)
    new["amihud_21d"] = W.rolling_mean(F.abs(W.logret(c, 1, w)) / (F.col("quote_volume") + 1.0), 21, w) * 1e9
    return out.withColumns(new).drop("_r", "_d", "_macd", "_signal", "vol_ewma_63d", *means)


def funding_daily(funding: DataFrame, by: Sequence[str] = ("asset",), at: str = "funding_time", rate: str = "funding_rate", tie: str | None = None) -> DataFrame:
    order = F.struct(at, tie) if tie else F.col(at)
    daily = funding.groupBy(*by, day_of(F.col(at)).alias("date")).agg(F.coalesce(F.sum(rate), F.lit(0.0)).alias("funding_1d"), F.max_by(rate, order).alias("funding_last"))
    w, f = W.series(by, "date"), F.col("funding_1d")
    return daily.withColumns({"funding_z_30d": W.zscore(f, 30, w), "funding_z_90d": W.zscore(f, 90, w), "funding_7d_cum": W.rolling_sum(f, 7, w), "funding_mom_7d": f - F.lag(f, 7).over(w)})


#: Daily positioning columns and the 5-minute ones they are means of.
POSITIONING = {
    "top_ls_pos_ratio": "sum_toptrader_long_short_ratio",
    "top_ls_acct_ratio": "count_toptrader_long_short_ratio",
    "global_ls_ratio": "count_long_short_ratio",
    "taker_ls_ratio": "sum_taker_long_short_vol_ratio",
}


def metrics_daily(metrics: DataFrame, by: Sequence[str] = ("asset",), at: str = "create_time", tie: str | None = None) -> DataFrame:
    order = F.struct(at, tie) if tie else F.col(at)
    daily = metrics.groupBy(*by, day_of(F.col(at)).alias("date")).agg(
        F.max_by("sum_open_interest", order).alias("oi"), F.max_by("sum_open_interest_value", order).alias("oi_usd"),
        *[F.avg(c).alias(k) for k, c in POSITIONING.items()],
    )
    w, oi = W.series(by, "date"), F.col("oi_usd")
    change = lambda n: oi / F.nullif(F.lag(oi, n).over(w), F.lit(0.0)) - 1
    return daily.withColumns(
        {"oi_chg_1d": change(1), "oi_chg_7d": change(7), "oi_z_90d": W.zscore(oi, 90, w), "positioning_missing": F.col("top_ls_pos_ratio").isNull()}
        | {f"{c}_z_{n}d": W.zscore(F.col(c), n, w) for c, n in (("top_ls_pos_ratio", 90), ("global_ls_ratio", 90), ("taker_ls_ratio", 30))}
    )


def dvol_daily(dvol: DataFrame, by: Sequence[str] = ("asset",), at: str = "time") -> DataFrame:
    w, iv = W.series(by, at), F.col("dvol_close")
    before = F.lag(iv, 5).over(w)
    return dvol.select(*by, F.col(at).alias("date"), (iv / 100.0).alias("iv_30d"), ((iv - before) / (before + EPS)).alias("iv_chg_5d"), W.zscore(iv, 90, w).alias("iv_z_90d"), ((F.col("dvol_high") - F.col("dvol_low")) / (iv + EPS)).alias("iv_intraday_range"))
