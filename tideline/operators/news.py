"""News features: fan-out to decision days, exponential decay, both eras, cut-over, abnormal attention."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import clock
from tideline.operators import windows as W

EPS = W.EPS
#: Half-lives in hours, the event types of scores, and the theme strings of each bucket.
HALF_LIVES = {"h1d": 24.0, "h3d": 72.0, "h7d": 168.0}
EVENT_TYPES = ("etf_flow", "regulation", "hack_exploit", "tech_upgrade", "macro", "exchange", "adoption", "legal", "other")
THEMES = {
    "macro": ("ECON_CENTRALBANK", "ECON_INTEREST", "ECON_INFLATION", "EPU_"),
    "regulation": ("REGULAT", "LEGISLAT", "TAX_", "SANCTION"),
    "hack": ("CYBER_ATTACK", "HACKER", "FRAUD", "CORRUPTION"),
    "solvency": ("BANKRUPT", "ECON_BUBBLE"),
}


def fan_out(rows: DataFrame, usable: str, day: str = "decision_day", days: int = 7) -> DataFrame:
    """Each row at every midnight D with usable < D <= usable + days, and its age in hours."""
    first = F.date_trunc("day", F.col(usable)) + F.expr("interval 1 day")
    last = F.col(usable) + F.expr(f"interval {days} days")
    kind = rows.schema[usable].dataType
    out = rows.where(F.col(usable).isNotNull()).withColumn(day, F.explode(F.sequence(first.cast(kind), last.cast(kind), F.expr("interval 1 day"))))
    return out.withColumn("age_h", F.timestamp_diff("SECOND", F.col(usable), F.col(day)) / F.lit(3600.0)).where("age_h > 0")


def decayed(value: Column, weight: Column, half_life: float) -> Column:
    """Aggregate: weighted mean, weights halving every half_life hours of age; rows with a null value still weigh."""
    w = weight * F.exp(-math.log(2) / half_life * F.col("age_h"))
    return F.coalesce(F.sum(value * w), F.lit(0.0)) / (F.coalesce(F.sum(w), F.lit(0.0)) + EPS)


def latest_scored(articles: DataFrame, scores: DataFrame, asset: str) -> DataFrame:
    """One row an article: its latest scored revision that tags the asset or is a duplicate; failed scores don't count."""
    rows = articles.join(scores.where("model <> 'failed'"), ["url_hash", "revision_no"])
    rows = rows.where(F.col("assets").like(f"%{asset.upper()}%") | F.col("duplicate_of").isNotNull())
    newest = F.row_number().over(Window.partitionBy("url_hash").orderBy(F.desc("revision_no")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("is_dup", F.col("duplicate_of").isNotNull())


def with_clock(rows: DataFrame) -> DataFrame:
    """Adds pit_usable_at and usable_at (not before five minutes after scoring); scores that came too late are dropped."""
    rows = rows.withColumn("pit_usable_at", clock.usable_at(F.col("published_at_utc"), F.col("first_seen_at_utc"), F.col("backfilled")))
    rows = rows.withColumn("usable_at", F.greatest("pit_usable_at", F.col("scored_at_utc") + F.expr("interval 5 minutes")))
    return rows.where(clock.not_late(F.col("usable_at"), F.col("pit_usable_at")))


def scored_daily(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily features from rows with usable_at, is_dup, is_price_report, sentiment, confidence, severity, event_type."""
    e = fan_out(rows, "usable_at")
    keys = [*by, "decision_day"]
    conf = F.coalesce("confidence", F.lit(0.5))
    scored = e.where("not is_dup")
    # columns of one aggregation instead of a filter each: one shuffle for all blocks
    sent = ~F.col("is_dup") & ~F.col("is_price_report")
    s = F.when(sent, F.col("sentiment"))
    wt = F.when(sent, conf)
    day = F.col("age_h") <= 24
    aggs = [F.when(F.count_if(sent) > 0, decayed(s, wt, h)).alias(f"news_sent_{k}") for k, h in HALF_LIVES.items()]
    aggs += [
        F.when(F.count_if(sent) > 0, F.coalesce(F.sum(F.when(s < -0.15, wt).otherwise(F.when(s.isNotNull(), F.lit(0.0)))), F.lit(0.0)) / (F.sum(wt) + EPS)).alias("news_neg_share"),
        F.stddev_samp(s).alias("news_dispersion"),
        F.max(F.when(sent, F.col("severity"))).alias("news_max_severity"),
        F.nullif(F.count_if(day), F.lit(0)).alias("news_count_24h"),
        F.avg(F.when(day, (~F.col("is_dup")).cast("double"))).alias("news_novel_share"),
        F.count_if(sent).alias("_sent"),
    ]
    out = e.groupBy(*keys).agg(*aggs).where("_sent > 0 or news_count_24h is not null").drop("_sent")
    events = scored.where(day).groupBy(*keys).pivot("event_type", list(EVENT_TYPES)).agg(F.coalesce(F.sum(F.col("severity") * conf), F.lit(0.0)))
    events = events.select(*keys, *[F.col(t).alias(f"evt_{t}") for t in EVENT_TYPES])
    return out.join(events, keys, "left").withColumn("era_llm", F.lit(1))


def tone_daily(gkg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily features from tone rows: tone is brought to the scale of scores by a fixed tenth."""
    themes = F.coalesce("themes", F.lit(""))
    e = fan_out(gkg.withColumn("usable_at", F.col("file_time") + F.expr(clock.LIVE)), "usable_at")
    tone, day = F.col("tone") / 10.0, F.col("age_h") <= 24
    aggs = [decayed(tone, F.lit(1.0), h).alias(f"news_sent_{k}") for k, h in HALF_LIVES.items()]
    aggs += [
        F.avg((tone < -0.2).cast("double")).alias("news_neg_share"),
        F.stddev_samp(tone).alias("news_dispersion"),
        F.avg("positive").alias("gdelt_pos_mag"),
        F.avg("negative").alias("gdelt_neg_mag"),
        F.avg("n_themes").alias("gdelt_complexity"),
        F.nullif(F.count_if(day), F.lit(0)).alias("news_count_24h"),
    ]
    for bucket, marks in THEMES.items():
        hit = reduce(lambda a, b: a | b, [themes.contains(m) for m in marks])
        aggs.append(F.avg(F.when(day, hit.cast("double"))).alias(f"gdelt_theme_{bucket}"))
    return e.groupBy(*by, "decision_day").agg(*aggs).withColumn("era_llm", F.lit(0))


def cut_over(tone: DataFrame, scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both eras by name, missing columns null; where both have a day, the tone era's row stays."""
    both = tone.unionByName(scored, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*by, "decision_day").orderBy("era_llm"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def abnormal_attention(daily: DataFrame, count: str = "news_count_24h", by: Sequence[str] = (), day: str = "decision_day") -> DataFrame:
    """Adds news_attn_abnormal, ln(1+n) - ln(1 + median of the same weekday over the eight weeks before), and low_news_flag, n below their tenth.

    Days without rows count as 0 between the first and last day of a key.
    """
    dense = W.densify(daily, day, by).withColumn(count, F.coalesce(count, F.lit(0)))
    dense = dense.withColumn("_dow", F.weekday(day))
    w = W.series([*by, "_dow"], day)
    dense = dense.withColumn("_before", F.lag(F.col(count).cast("double")).over(w))
    base, low = W.rolling_median(F.col("_before"), 8, w), W.rolling_quantile_nearest(F.col("_before"), 0.1, 8, w)
    return dense.withColumns({"news_attn_abnormal": F.ln(1 + F.col(count)) - F.ln(1 + base), "low_news_flag": F.col(count) < low}).drop("_dow", "_before")
