"""Registered queries of labels made from raw bars, and of the permutation check of a regime."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import labels
from tideline.plans import frames, gates
from tideline.plans.frames import REGIME_DAYS
from tideline.plans.queries import BAR_IDX, query

#: Ten days of span and two of warm-up: the events table has a month.
SPAN, WARM, DAY, HORIZON = 10, 2, 24, 24
CFG = labels.Barriers(horizon=HORIZON)
ALPHA = 2 / (SPAN * DAY + 1)
#: Falls of the weights by return: e ** (-FALL * age).
FALL = f"(-ln(1 - {ALPHA!r}::DOUBLE))"

EW = f"""SELECT asset, idx, high, low, close, CASE WHEN k >= {WARM * DAY} THEN sqrt(greatest(q / d - (m / d) * (m / d), 0)) END AS sigma FROM (SELECT *, sum(w) OVER u AS d, sum(w * r) OVER u AS m, sum(w * r * r) OVER u AS q, count(r) OVER u AS k
    FROM (SELECT *, CASE WHEN r IS NOT NULL THEN exp(idx * {FALL}) * CASE WHEN idx = {DAY} THEN 1 / {ALPHA!r}::DOUBLE ELSE 1 END END AS w FROM (
        SELECT asset, idx, high, low, close, ln(close / lag(close, {DAY}) OVER (PARTITION BY asset ORDER BY idx)) AS r FROM ({BAR_IDX}))) WINDOW u AS (PARTITION BY asset ORDER BY idx ROWS UNBOUNDED PRECEDING))"""


def _sampled(ks) -> str:
    """CTEs b (bars with sigma and step) and fired (asset, k, idx): CUSUM sampling, a bar at a time."""
    grid = ", ".join(f"({k!r}::DOUBLE)" for k in ks)
    return f"""b AS MATERIALIZED (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY idx)) AS r FROM ({EW})), ks(k) AS (VALUES {grid}),
    s AS (SELECT asset, k, 0::BIGINT AS idx, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, false AS fired FROM b, ks WHERE idx = 0 UNION ALL
        SELECT asset, k, idx, CASE WHEN up >= h THEN 0 ELSE up END, CASE WHEN NOT coalesce(up >= h, false) AND dn <= -h THEN 0 ELSE dn END, coalesce(up >= h OR dn <= -h, false) FROM (
            SELECT b.asset, s.k, b.idx, greatest(0, s.p + b.r) AS up, least(0, s.n + b.r) AS dn, b.sigma * s.k AS h FROM s JOIN b ON b.asset = s.asset AND b.idx = s.idx + 1)),
    fired AS (SELECT asset, k, idx FROM s WHERE fired)"""


def _touched(mult: float, name: str) -> str:
    """CTE of labels by barrier multiple, of events fired."""
    return f"""{name}_t AS (SELECT f.asset, f.k, f.idx AS t0, close AS p0, sigma AS trgt, close * (1 + {mult}::DOUBLE * sigma) AS up, close * (1 - {mult}::DOUBLE * sigma) AS dn FROM fired f JOIN b USING (asset, idx) WHERE sigma >= 1e-4),
    {name}_x AS (SELECT t.asset, t.k, t.t0, any_value(t.p0) AS p0, count(*) AS n, min(CASE WHEN b.idx > t0 AND high >= up THEN b.idx END) AS iu, min(CASE WHEN b.idx > t0 AND low <= dn THEN b.idx END) AS id,
        max(CASE WHEN b.idx = t0 + {HORIZON} THEN b.close END) AS last FROM {name}_t t JOIN b ON t.asset = b.asset AND b.idx BETWEEN t.t0 AND t.t0 + {HORIZON} GROUP BY 1, 2, 3),
    {name} AS (SELECT *, CASE touch WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE sign(last / p0 - 1)::INTEGER END AS label FROM (
        SELECT *, CASE WHEN iu IS NULL AND id IS NULL THEN 'vertical' WHEN id IS NULL OR iu < id THEN 'up' ELSE 'down' END AS touch FROM {name}_x WHERE n = {HORIZON + 1}))"""


def _raw(spark, sf) -> DataFrame:
    return frames.event_bars(spark, sf).withColumns({c: F.col(c) + 50 for c in ("high", "low", "close")})


def _volatile(spark, sf) -> DataFrame:
    return labels.with_volatility(labels.numbered(_raw(spark, sf), ["asset"], "open_time"), span_days=SPAN, min_days=WARM)


@query(f"SELECT asset, idx, round(sigma, 6) AS sigma FROM ({EW})")
def day_volatility(spark, sf):
    return _volatile(spark, sf).select("asset", "idx", F.round("sigma", 6).alias("sigma"))


@query(f"""WITH RECURSIVE {_sampled(labels.K_GRID)}, {_touched(1.5, "y")}
    SELECT asset, k, count(*) AS events, count(*) FILTER (label = 1) AS up, count(*) FILTER (touch = 'vertical') AS vertical FROM y GROUP BY 1, 2""")
def generated_labels(spark, sf):
    vol = _volatile(spark, sf)
    ev = labels.triple_barrier(labels.cusum_events(vol, labels.K_GRID), vol, CFG, keep=["k"])
    return ev.groupBy("asset", "k").agg(F.count("*").alias("events"), F.count_if(F.col("label") == 1).alias("up"), F.count_if(F.col("touch") == "vertical").alias("vertical"))


MOST = 1000


@query(f"""WITH RECURSIVE {_sampled(labels.K_GRID)}, {_touched(1.5, "y")}, n AS (SELECT ks.k, count(y.t0) AS n FROM ks LEFT JOIN y ON y.k = ks.k GROUP BY 1)
    SELECT coalesce(min(k) FILTER (n <= {MOST}), max(k)) AS k FROM n""")
def calibrated_threshold(spark, sf):
    """The sampling threshold that gives at most so many events."""
    return spark.createDataFrame([(labels.calibrated_k(_volatile(spark, sf), CFG, most=MOST),)], "k double")


K = 0.75


@query(f"""WITH RECURSIVE {_sampled([K])}, {_touched(1.5, "y")}, l AS (SELECT max(t0) AS t, asset FROM y GROUP BY asset), {_touched(1.0, "one")}, {_touched(2.0, "two")},
    times AS (SELECT asset, open_time, row_number() OVER (PARTITION BY asset ORDER BY open_time) - 1 AS idx FROM ({BAR_IDX})), until AS (SELECT max(open_time) AS t FROM y JOIN times ON times.asset = y.asset AND times.idx = y.t0),
    every AS (SELECT '_m10' AS variant, * FROM one UNION ALL SELECT '_m20', * FROM two)
    SELECT variant, every.asset, count(*) AS events, count(*) FILTER (label = 1) AS up, count(*) FILTER (label = -1) AS down, count(*) FILTER (touch = 'vertical') AS vertical
    FROM every JOIN times ON times.asset = every.asset AND times.idx = every.t0 WHERE times.open_time <= (SELECT t FROM until) GROUP BY 1, 2""")
def label_variants(spark, sf):
    """Label sets for other barriers over the events of the default set."""
    raw, volatility = _raw(spark, sf), {"span_days": SPAN, "min_days": WARM}
    base = labels.generate(raw, CFG, K, **volatility)
    out = None
    for suffix, one in labels.generate_variants(raw, base, [1.0, 2.0], CFG, **volatility).items():
        s = labels.summary(one).select(F.lit(suffix).alias("variant"), "asset", "events", "up", "down", "vertical")
        out = s if out is None else out.unionAll(s)
    return out


PERMUTED, SEED = 120, 42
_rng = random.Random(SEED)
DRAWN = ", ".join(f"({_rng.random()!r}::DOUBLE)" for _ in range(PERMUTED))


@query(f"""WITH r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) AS i, (rank() OVER (ORDER BY crypto_stress) + (count(*) OVER (PARTITION BY crypto_stress) - 1) / 2.0) AS rx,
    (rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2.0) AS ry FROM ({REGIME_DAYS})), n AS (SELECT count(*) AS n FROM r), d(u) AS (VALUES {DRAWN}),
    k AS (SELECT 1 + floor(u * (n - 1))::BIGINT AS k, count(*) AS times FROM d, n GROUP BY 1 UNION ALL SELECT 0, 0),
    c AS (SELECT k, any_value(times) AS times, corr(a.rx, b.ry) AS rho FROM k, n, r a JOIN r b ON b.i = (a.i - 1 + k) % n + 1 GROUP BY 1), seen AS (SELECT rho FROM c WHERE k = 0)
    SELECT round(any_value(seen.rho), 6) AS rho, round((coalesce(sum(times) FILTER (c.rho >= seen.rho AND k > 0), 0) + 1) / {PERMUTED + 1}, 6) AS p_value FROM c, seen""")
def permutation_p(spark, sf):
    out = gates.permutation_p(frames.regime_days(spark, sf), "crypto_stress", "confidence", "date", PERMUTED, SEED)
    return out.select(F.round("rho", 6).alias("rho"), F.round("p_value", 6).alias("p_value"))
