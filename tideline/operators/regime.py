"""Regime series: smoothing over calendar days, transitions, runs, and headlines to classify."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import windows as W

#: Headlines of a day: at most so many of either kind; word sets more alike than this are one story.
CRYPTO, MACRO, ALIKE = 15, 7, 0.55


def smoothed(regime: DataFrame, by: Sequence[str] = (), day: str = "date") -> DataFrame:
    """Three-day medians by date, not by row; the day-over-day change only between neighbouring days; usable the next day."""
    at = F.unix_date(F.col(day).cast("date"))
    w = Window.partitionBy(*by).orderBy(at)
    three = w.rangeBetween(-2, 0)
    gap = F.datediff(F.col(day).cast("date"), F.lag(F.col(day).cast("date")).over(w))
    return regime.select(
        *by, F.date_add(F.col(day).cast("date"), 1).alias("decision_day"),
        *[F.percentile(c, 0.5).over(three).alias(f"regime_{c}") for c in ("risk_appetite", "crypto_stress", "macro_stress")],
        F.when(gap <= 1, F.col("risk_appetite") - F.lag("risk_appetite").over(w)).alias("regime_ra_delta"),
        F.col("confidence").alias("regime_confidence"), gap.alias("regime_gap_days"),
    )


def transitions(states: DataFrame, state: str, day: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, from_state, to_state, n, share) over neighbouring calendar days."""
    w = W.series(by, day)
    pairs = states.where(F.col(state).isNotNull()).select(*by, F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state"), F.datediff(day, F.lag(day).over(w)).alias("_gap"))
    counts = pairs.where("_gap = 1").groupBy(*by, "from_state", "to_state").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from_state")))


def run_lengths(states: DataFrame, state: str, day: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, run, value, length) of maximal runs of equal neighbouring values."""
    return W.islands(states, state, by, day).groupBy(*by, "run").agg(F.first(state).alias("value"), F.count("*").alias("length"))


def headlines(pages: DataFrame, day: str = "day", url: str = "url", rank: str = "n_themes", slug: Column | None = None, crypto: Column | None = None, anonymous: bool = True) -> DataFrame:
    """(day, kind, position, headline): the first stories of a day by rank, then URL, near copies left out, names and dates taken out if ``anonymous``.

    ``slug``, of the columns day and url, and ``crypto``, of these and slug, say what the story is where the URL's own words don't. Slugs, kinds and word sets are column expressions. The choice itself depends on what was chosen before, so
    a day's rows, cut to distinct slugs, are gone through in one task.
    """
    slugs = pages.select(day, F.col(url).alias("url"), rank).groupBy(day, "url").agg(F.max(rank).alias(rank))
    slugs = slugs.withColumn("slug", text.slug(F.col("url")) if slug is None else slug).where("slug is not null").withColumn("crypto", text.is_crypto(F.col("slug")) if crypto is None else crypto)
    kind = slugs.schema[day].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([rank, "url"], ascending=[False, True])
        left, seen, out = {True: CRYPTO, False: MACRO}, [], []
        for slug, crypto in zip(pdf["slug"], pdf["crypto"], strict=True):
            words = set(slug.split())
            if left[crypto] and all(len(words & s) <= ALIKE * len(words | s) for s in seen):
                seen.append(words)
                left[crypto] -= 1
                out.append((pdf[day].iloc[0], "crypto" if crypto else "macro", len(out), slug))
                if not any(left.values()):
                    break
        return pd.DataFrame(out, columns=[day, "kind", "position", "slug"])

    chosen = slugs.groupBy(day).applyInPandas(choose, f"{day} {kind}, kind string, position int, slug string")
    said = text.anonymise(F.col("slug"))["text"] if anonymous else F.col("slug")
    return chosen.select(day, "kind", "position", said.alias("headline"))


def prompt(chosen: DataFrame, day: str = "day") -> DataFrame:
    """(day, prompt): a day's headlines as lines under a title for each kind."""
    lines = chosen.groupBy(day).pivot("kind", ["crypto", "macro"]).agg(F.sort_array(F.collect_list(F.struct("position", "headline"))))
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast(lines.schema["crypto"].dataType)), lambda x: F.concat(F.lit("- "), x["headline"])), "\n")
    return lines.select(day, F.concat(F.lit("Crypto headlines:\n"), listed(F.col("crypto")), F.lit("\n\nMacro headlines:\n"), listed(F.col("macro"))).alias("prompt"))
