"""The feature matrix: one row for every key and decision day, joined from blocks that were known by then."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.asof import asof_published

#: Hours after which a published value counts as stale.
CAPS = {"macro": 240, "onchain": 48, "stablecoins": 48, "etf": 120, "fng": 72}


@dataclass(frozen=True)
class Published:
    """A block joined as of its publication: columns ``{prefix}_{value}`` and ``{prefix}_age_h``; ``by`` is empty where it holds for every key."""

    frame: DataFrame
    values: Sequence[str]
    prefix: str
    cap_hours: float
    by: Sequence[str] = ("asset",)


def spine(daily: DataFrame, day: str = "date", today: object = None) -> DataFrame:
    """A bar of day D-1 decides on day D; the bar of ``today`` isn't complete and is left out."""
    held = daily if today is None else daily.where(F.col(day) < F.lit(today))
    return held.withColumn("decision_day", (F.col(day) + F.expr("interval 1 day")).cast(daily.schema[day].dataType))


def shifted(block: DataFrame, day: str = "date") -> DataFrame:
    """A daily block keyed by the day it decides on."""
    return block.withColumn("decision_day", (F.col(day) + F.expr("interval 1 day")).cast(block.schema[day].dataType)).drop(day)


def assemble(daily: DataFrame, blocks: Mapping[str, DataFrame] | None = None, published: Sequence[Published] = (), news: DataFrame | None = None, by: Sequence[str] = ("asset",), day: str = "date", today: object = None) -> DataFrame:
    """The matrix from price bars with features, daily blocks (funding, positioning, iv: joined on the day they decide on),
    published blocks and news by decision day. Missing positioning reads as true; vrp_daily is there if iv is."""
    out = spine(daily, day, today)
    for block in (blocks or {}).values():
        out = out.join(shifted(block, day), [*by, "decision_day"], "left")
    if "positioning_missing" in out.columns:
        out = out.withColumn("positioning_missing", F.coalesce("positioning_missing", F.lit(True)))
    if "iv_30d" in out.columns:
        out = out.withColumn("vrp_daily", F.col("iv_30d") / 365**0.5 - F.col("vol_ewma_21d"))
    for p in published:
        out = asof_published(out, p.frame, p.values, p.prefix, p.cap_hours, p.by)
    return out.join(news, [*(b for b in by if b in news.columns), "decision_day"], "left") if news is not None else out


def macro_blocks(macro: DataFrame, series: Sequence[str], cap: float = CAPS["macro"]) -> list[Published]:
    """A block for each series of a long table (series, value, published_at)."""
    return [Published(macro.where(F.col("series") == s), ["value"], f"macro_{s.lower()}", cap, ()) for s in series]


def duplicates(matrix: DataFrame, by: Sequence[str] = ("asset",)) -> DataFrame:
    """Keys and days with more than one row: would multiply label rows."""
    return matrix.groupBy(*by, "decision_day").count().where("count > 1")


def check_unique(matrix: DataFrame, by: Sequence[str] = ("asset",)) -> None:
    if found := duplicates(matrix, by).head(1):
        raise ValueError(f"the matrix has repeated rows for {found[0]}")


def coverage(matrix: DataFrame, prefixes: Mapping[str, str], by: Sequence[str] = ("asset",), days: int = 30) -> DataFrame:
    """(by, block, null_share): nulls in the first column of each block over the last ``days`` decision days of a key."""
    from pyspark.sql import Window

    recent = matrix.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("decision_day")))).where(F.col("_n") <= days)
    firsts = {b: next((c for c in matrix.columns if c.startswith(p)), None) for b, p in prefixes.items()}
    stack = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(c).isNull().cast("double").alias("_null")) for b, c in firsts.items() if c]))
    return recent.select(*by, stack.alias("x")).groupBy(*by, "x.block").agg(F.avg("x._null").alias("null_share"))
