"""Checks of a daily regime score against what markets did afterwards."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.stats import auc, spearman
from tideline.operators import regime as R
from tideline.operators import windows as W
from tideline.operators.ranges import interval_join

RHO, P, RUN, PREFERRED_RUN = 0.2, 0.05, 3.0, 5.0
HOURS, COVERAGE, LEAST, LEAST_SIDE = 168, 0.9, 30, 5


def forward_outcomes(bars: DataFrame, by: Sequence[str] = (), at: str = "open_time", days: int = 7, least: int = int(COVERAGE * HOURS)) -> DataFrame:
    """(by, date, fwd_vol_7d, fwd_maxdd_7d, fwd_n_bars): realised volatility and largest drawdown over bars in [D+1, D+8); null below the least number of bars."""
    first = F.row_number().over(Window.partitionBy(*by, at).orderBy("close"))
    held = bars.select(*by, at, "close").withColumn("_n", first).where("_n = 1").drop("_n")
    w = W.series(by, at)
    held = held.select(*by, F.unix_date(F.to_date(at)).cast("long").alias("d"), F.col(at).alias("t"), "close", F.coalesce(W.logret(F.col("close"), 1, w), F.lit(0.0)).alias("r"))
    ends = held.groupBy(*by).agg(F.min("d").alias("a"), F.max("d").alias("b"))
    calendar = ends.select(*by, F.explode(F.sequence("a", "b")).alias("day")).withColumns({"lo": F.col("day") + 1, "hi": F.col("day") + days})
    seen = interval_join(calendar, held, "lo", "hi", "d", by, days)
    peak = F.max("close").over(Window.partitionBy(*by, "day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    out = seen.withColumn("dd", 1.0 - F.col("close") / peak).groupBy(*by, "day").agg(F.count("*").alias("n"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("v"), F.max("dd").alias("dd"))
    out = calendar.join(out, [*by, "day"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(*by, F.date_from_unix_date(F.col("day").cast("int")).alias("date"), F.when(n >= least, F.col("v")).alias("fwd_vol_7d"), F.when(n >= least, F.col("dd")).alias("fwd_maxdd_7d"), n.alias("fwd_n_bars"))


def rotation_correlations(df: DataFrame, x: str, y: str, order: str, offsets: Sequence[int]) -> DataFrame:
    """(k, rho): rank correlation after rotating x by k places, which keeps its own memory. One series of a few thousand rows: the work is rows times offsets."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.row_number().over(Window.orderBy(order)).alias("i"), W.midrank(x).alias("rx"), W.midrank(y).alias("ry"))
    n = ranked.agg(F.count("*").alias("n"))
    ks = df.sparkSession.createDataFrame([(int(k),) for k in offsets], "k int")
    left = ranked.select("i", "rx").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(ks)).select("k", (F.pmod(F.col("i") - 1 + F.col("k"), F.col("n")) + 1).alias("i"), "rx")
    return left.join(ranked.select("i", "ry"), "i").groupBy("k").agg(F.corr("rx", "ry").alias("rho"))


def permutation_p(df: DataFrame, x: str, y: str, order: str, n_perm: int = 1000, seed: int = 42) -> DataFrame:
    """(rho, p_value): one-sided, by random rotations that are never none."""
    n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).count()
    if n < 2:
        return df.sparkSession.createDataFrame([(None, None)], "rho double, p_value double")
    drawn = random.Random(seed).choices(range(1, n), k=n_perm)
    counts: dict[int, int] = {}
    for k in drawn:
        counts[k] = counts.get(k, 0) + 1
    times = df.sparkSession.createDataFrame(list(counts.items()), "k int, times int")
    all_k = rotation_correlations(df, x, y, order, [0, *counts])
    seen = all_k.where("k = 0").select(F.col("rho").alias("seen"))
    found = all_k.where("k > 0").join(F.broadcast(times), "k").crossJoin(F.broadcast(seen))
    return found.groupBy(F.col("seen").alias("rho")).agg(((F.sum(F.when(F.col("rho") >= F.col("seen"), F.col("times")).otherwise(0)) + 1) / (n_perm + 1)).alias("p_value"))


def welch(df: DataFrame, value: str, low, high) -> DataFrame:
    """(n_low, n_high, mean_low, mean_high, difference, t) of a value where one condition holds and where the other does."""
    a, b = F.when(low, F.col(value)), F.when(high, F.col(value))
    out = df.agg(F.count(a).alias("n_low"), F.count(b).alias("n_high"), F.avg(a).alias("mean_low"), F.avg(b).alias("mean_high"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    root = F.sqrt(F.col("va") / F.nullif("n_low", F.lit(0)) + F.col("vb") / F.nullif("n_high", F.lit(0)))
    diff = F.col("mean_low") - F.col("mean_high")
    return out.select("n_low", "n_high", "mean_low", "mean_high", diff.alias("difference"), (diff / F.nullif(root, F.lit(0.0))).alias("t"))


def validate(regime: DataFrame, outcomes: DataFrame, n_perm: int = 1000, seed: int = 42) -> dict[str, dict]:
    """All checks as a report: each has a status, its figures, and a gate (None where it can't be told)."""
    missing = {"date", "risk_appetite", "crypto_stress", "macro_stress", "confidence"} - set(regime.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    joined = regime.join(outcomes, "date", "left").cache()
    try:
        return _validate(regime, joined, n_perm, seed)
    finally:
        joined.unpersist()


def _validate(regime: DataFrame, joined: DataFrame, n_perm: int, seed: int) -> dict[str, dict]:
    out: dict[str, dict] = {}
    usable = joined.where("crypto_stress is not null and fwd_vol_7d is not null")
    n = usable.count()
    rho = spearman(usable, "crypto_stress", "fwd_vol_7d").first()
    if n < LEAST or rho["rho"] is None:
        out["spearman"] = {"status": "unavailable", "n": n, "gate": None}
    else:
        p = permutation_p(usable, "crypto_stress", "fwd_vol_7d", "date", n_perm, seed).first()
        out["spearman"] = {"status": "ok", "n": n, "rho": rho["rho"], "p_value": p["p_value"], "gate": rho["rho"] > RHO and p["p_value"] < P}
    w = welch(joined.where("risk_appetite is not null and fwd_maxdd_7d is not null"), "fwd_maxdd_7d", F.col("risk_appetite") <= -1, F.col("risk_appetite") >= 1).first().asDict()
    ok = min(w["n_low"], w["n_high"]) >= LEAST_SIDE
    out["event_study"] = w | {"status": "ok" if ok else "unavailable", "gate": w["mean_low"] > w["mean_high"] if ok else None}
    signs = regime.where("risk_appetite is not null").select("date", F.signum(F.col("risk_appetite").cast("double")).alias("s"))
    runs = R.run_lengths(signs, "s", "date").agg(F.avg("length").alias("mean_run"), F.count("*").alias("n_runs"), F.max("length").alias("max_run")).first().asDict()
    states = R.transitions(regime, "crypto_stress", "date").collect()  # states squared
    known = runs["mean_run"] is not None
    out["persistence"] = runs | {"status": "ok" if known else "unavailable", "transitions": [r.asDict() for r in states], "gate": runs["mean_run"] >= RUN if known else None, "meets_preferred": runs["mean_run"] >= PREFERRED_RUN if known else None}
    top = usable.withColumn("_top", F.percentile("fwd_vol_7d", 0.9).over(Window.partitionBy()))
    flagged = top.select((F.col("crypto_stress") >= 2).cast("double").alias("s"), (F.col("fwd_vol_7d") >= F.col("_top")).cast("int").alias("l"))
    area = auc(flagged, "s", "l").first() if n >= LEAST else None
    out["auc"] = {"status": "ok" if area and area["auc"] is not None else "unavailable", "n": n, "auc": area["auc"] if area else None, "gate": None}
    gates = {k: out[k]["gate"] for k in ("spearman", "event_study", "persistence")}
    out["summary"] = {"gates": gates, "all_gates_pass": all(g is True for g in gates.values()), "any_unavailable": None in gates.values()}
    return out


def report(results: dict[str, dict]) -> str:
    """The report as lines of text."""
    word = {True: "PASS", False: "FAIL", None: "UNAVAILABLE"}
    lines = []
    for name in ("spearman", "event_study", "persistence", "auc"):
        figures = ", ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in results[name].items() if k not in ("status", "gate", "transitions"))
        lines.append(f"{name}: {word[results[name]['gate']]} ({results[name]['status']}; {figures})")
    return "\n".join([*lines, f"all gates pass: {results['summary']['all_gates_pass']}"])
