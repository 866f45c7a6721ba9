"""When a value is known: publication clocks as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE, BACKFILL, LATE = "interval 30 minutes", "interval 4 hours", "interval 7 days"


def usable_at(published: Column, first_seen: Column, backfilled: Column) -> Column:
    """Earliest time a row may be used: the later of publication and sighting plus the live buffer; for backfilled rows publication plus the larger one."""
    live = F.greatest(first_seen, published) + F.expr(LIVE)
    return F.when(backfilled & published.isNotNull(), published + F.expr(BACKFILL)).otherwise(live)


def is_usable(usable: Column, decision: Column, window: str = "interval 24 hours") -> Column:
    """decision - window < usable <= decision."""
    return (usable <= decision) & (usable > decision - F.expr(window))


def not_late(usable: Column, clock: Column, most: str = LATE) -> Column:
    """A score that came later than ``most`` after its article was usable has no news value left."""
    return usable <= clock + F.expr(most)


def from_epoch(x: Column) -> Column:
    """Epoch seconds, milliseconds or microseconds, told apart by magnitude."""
    micros = F.when(F.abs(x) > 1e15, x).when(F.abs(x) > 1e11, x * 1000).otherwise(x * 1_000_000)
    return F.timestamp_micros(micros.cast("long"))


def federal_holidays(first: int, last: int) -> list[dt.date]:
    """US federal holidays by rule: fixed days moved off weekends, and n-th weekdays of a month."""
    out = []
    for year in range(first, last + 1):
        for month, day in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25)):
            d = dt.date(year, month, day)
            out.append(d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0)))
        # (month, weekday from Monday, which; -1: the last)
        for month, weekday, which in ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4)):
            days = [d for n in range(31) if (d := dt.date(year, month, 1) + dt.timedelta(n)).month == month and d.weekday() == weekday]
            out.append(days[which] if which < 0 else days[which - 1])
    return out


def business_calendar(spark: SparkSession, first: int = 2019, last: int = 2031) -> DataFrame:
    """(day, business, rank): rank numbers business days; a day off has that of the next one. About 4,000 rows."""
    off = ", ".join(f"date '{d}'" for d in federal_holidays(first, last))
    days = spark.sql(f"select explode(sequence(date '{first}-01-01', date '{last}-12-31', interval 1 day)) as day")
    days = days.withColumn("business", (F.weekday("day") < 5) & ~F.expr(f"day in ({off})"))
    from pyspark.sql import Window

    before = F.sum(F.col("business").cast("int")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("rank", before - F.col("business").cast("int") + 1)


def released_at(df: DataFrame, ref_date: str, busdays: Column, et_time: Column, name: str = "published_at") -> DataFrame:
    """Adds the UTC time of a release ``busdays`` business days after the reference date (rolled forward to one) at New York time ``et_time``."""
    calendar = business_calendar(df.sparkSession)
    ref = F.broadcast(calendar.select(F.col("day").alias("_ref"), F.col("rank").alias("_rank")))
    due = F.broadcast(calendar.where("business").select(F.col("day").alias("_day"), F.col("rank").alias("_due")))
    out = df.withColumn("_n", busdays).join(ref, F.col(ref_date).cast("date") == F.col("_ref"), "left")
    out = out.join(due, F.col("_rank") + F.col("_n") == F.col("_due"), "left")
    local = F.to_timestamp(F.concat_ws(" ", F.col("_day").cast("string"), et_time), "yyyy-MM-dd HH:mm")
    return out.withColumn(name, F.to_utc_timestamp(local, "America/New_York")).drop("_n", "_ref", "_rank", "_day", "_due")
