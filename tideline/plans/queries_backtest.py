"""Registered queries of back-tests: each step of the engine over daily bars, and the whole of it for all candidates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.operators import windows as W
from tideline.plans import backtest, frames
from tideline.plans.frames import ORDER_BARS
from tideline.plans.queries import ORACLE, _ewm, _full, query, rounded

# ---- SQL of each step, over (asset, day, close)

#: Order prices have no memory, so levels about 50 that they move by some hundredths stand for an index.
PRICES = f"SELECT asset, date AS day, 50 + close / 100000 AS close, row_number() OVER (PARTITION BY asset ORDER BY date) AS i FROM ({ORDER_BARS})"
U = "WINDOW u AS (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING)"
A30, A36 = W.alpha_of(span=30), W.alpha_of(span=36)
RETURNS = f"""SELECT *, sqrt(greatest(q - m * m, 0)) * sqrt(365.0::DOUBLE) AS vol FROM (SELECT *, {_ewm("ret", A30)} AS m, {_ewm("(ret * ret)", A30)} AS q
    FROM (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1, 0) AS ret FROM ({PRICES})) {U})"""
BASE = f"SELECT *, CASE WHEN row_number() OVER u > 365 THEN vol > quantile_cont(vol, 0.8) OVER u ELSE false END AS hv FROM ({RETURNS}) {U}"


def _gate(n: int) -> str:
    return f"(CASE WHEN count(close) OVER g{n} = {n} AND close > avg(close) OVER g{n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _rows(name: str, first: int, last: str = "CURRENT ROW") -> str:
    return f"{name} AS (PARTITION BY asset ORDER BY day ROWS BETWEEN {first} PRECEDING AND {last})"


def _donchian(entry: int, out: int, gate: int) -> str:
    side = lambda n, agg, w: f"CASE WHEN count(close) OVER {w} = {n} THEN {agg}(close) OVER {w} END"
    return f"""SELECT asset, day, coalesce(last_value(forced IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS scalar FROM (
        SELECT asset, day, CASE WHEN gate = 0 THEN 0.0 WHEN close <= lo THEN 0.0 WHEN close >= hi THEN 1.0 END AS forced FROM (
            SELECT asset, day, close, {_gate(gate)} AS gate, {side(out, "min", "lows")} AS lo, {side(entry, "max", "highs")} AS hi FROM ({PRICES})
            WINDOW {_rows(f"g{gate}", gate - 1)}, {_rows("lows", out, "1 PRECEDING")}, {_rows("highs", entry, "1 PRECEDING")}))"""


def _forecast(fast: int, slow: int, k: float) -> str:
    return f"CASE WHEN sd > 0 THEN least(greatest((e{fast} - e{slow}) / sd * {k}::DOUBLE, -20), 20) END"


EWMAC = f"""SELECT asset, day, coalesce(least(greatest(({_forecast(8, 32, 5.3)} + {_forecast(32, 128, 2.65)}) / 2 / 10, 0), 1), 0) * gate AS scalar FROM (
    SELECT *, sqrt(greatest(dq - dm * dm, 0)) AS sd FROM (SELECT asset, day, {_gate(200)} AS gate, {", ".join(f"{_ewm('close', W.alpha_of(span=n))} AS e{n}" for n in (8, 32, 128))}, {_ewm("d", A36)} AS dm, {_ewm("(d * d)", A36)} AS dq
        FROM (SELECT *, close - lag(close) OVER (PARTITION BY asset ORDER BY day) AS d FROM ({PRICES})) {U}, {_rows("g200", 199)}))"""


def _sma(n: int) -> str:
    return f"SELECT asset, day, {_gate(n)} AS scalar FROM ({PRICES}) WINDOW {_rows(f'g{n}', n - 1)}"


def _signal(config: dict) -> str:
    kind = config["kind"]
    if kind == "combo":
        return "SELECT asset, day, avg(scalar) AS scalar FROM (" + " UNION ALL ".join(f"({_signal(backtest.CANDIDATES[n])})" for n in config["of"]) + ") GROUP BY 1, 2"
    if kind == "sma":
        return _sma(config["sma"])
    if kind == "donchian":
        return _donchian(config["entry"], config["exit"], config["gate"])
    return EWMAC if kind == "ewmac" else f"SELECT asset, day, 1.0::DOUBLE AS scalar FROM ({PRICES})"


SIGNALS = " UNION ALL ".join(f"SELECT '{n}' AS name, * FROM ({_signal(c)})" for n, c in backtest.CANDIDATES.items())
TARGETS = f"""SELECT name, asset, day, ret, hv, coalesce(raw * least(1.0, 0.8 / nullif(sum(raw) OVER (PARTITION BY name, day), 0)), raw) AS target FROM (
    SELECT name, asset, day, ret, hv, least(scalar * 0.12::DOUBLE * 0.5 / greatest(vol, 0.2::DOUBLE), 0.5) AS raw FROM ({SIGNALS}) JOIN ({BASE}) USING (asset, day))"""
#: Weights that move only if the target is far enough off: each day needs the day before.
HELD = f"""t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY name, asset ORDER BY day) AS i FROM ({TARGETS})),
    h AS (SELECT name, asset, 0::BIGINT AS i, 0.0::DOUBLE AS held FROM t WHERE i = 1 UNION ALL
        SELECT t.name, t.asset, t.i, CASE WHEN abs(t.target - h.held) >= greatest(0.1::DOUBLE * t.target, 0.01::DOUBLE) THEN t.target ELSE h.held END FROM h JOIN t ON t.name = h.name AND t.asset = h.asset AND t.i = h.i + 1),
    held AS (SELECT name, asset, day, ret, hv, target, held FROM h JOIN t USING (name, asset, i))"""
RATE = "(extract(month FROM day) * 0.004::DOUBLE)"
LEDGERS = f"""moves AS (SELECT *, abs(held - coalesce(lag(held) OVER w, 0)) AS moved, coalesce(lag(held) OVER w, 0) AS held0 FROM held WINDOW w AS (PARTITION BY name, asset ORDER BY day)),
    earned AS (SELECT name, day, held, held0, held0 * ret AS g, coalesce(lag(moved * (0.001 + 0.001 * CASE WHEN hv THEN 2 ELSE 1 END)) OVER w, 0) AS c, coalesce(lag(moved) OVER w, 0) AS m FROM moves WINDOW w AS (PARTITION BY name, asset ORDER BY day)),
    days AS (SELECT name, day, sum(g) AS gross, sum(c) AS cost, sum(held) AS exposure, sum(m) AS turnover, sum(g) - sum(c) AS net,
        sum(g) - sum(c) + least(greatest(1 - greatest(sum(held), sum(held0)), 0), 1) * {RATE} / 365 AS with_yield FROM earned GROUP BY 1, 2)"""


def _prices(spark, sf) -> DataFrame:
    return frames.order_bars(spark, sf).select("asset", F.col("date").alias("day"), (50 + F.col("close") / 100000).alias("close"))


# ---- signals and sizing


@query(f"SELECT asset, day, round(scalar, 6) AS scalar FROM ({EWMAC})")
def ewmac_signal(spark, sf):
    return rounded(backtest.signal(_prices(spark, sf), backtest.CANDIDATES["S3_EWMAC"]), ["asset", "day"], ["scalar"])


@query(f"SELECT asset, day, round(scalar, 6) AS scalar FROM ({_signal(backtest.CANDIDATES['COMBO'])})")
def combined_signal(spark, sf):
    p = _prices(spark, sf)
    return rounded(backtest.combined([backtest.signal(p, backtest.CANDIDATES[n]) for n in backtest.CANDIDATES["COMBO"]["of"]]), ["asset", "day"], ["scalar"])


@query(f"SELECT asset, day, round(vol, 6) AS vol, hv FROM ({BASE})")
def volatility_regimes(spark, sf):
    return rounded(backtest.high_volatility(backtest.returns(_prices(spark, sf))), ["asset", "day", "hv"], ["vol"])


@query(f"WITH RECURSIVE {HELD} SELECT asset, day, round(target, 6) AS target, round(held, 6) AS held FROM held WHERE name = 'S2_DONCH_N20'")
def sized_weights(spark, sf):
    """Targets by volatility under both caps, and the weights held behind the no-trade buffer."""
    base = backtest.high_volatility(backtest.returns(_prices(spark, sf)))
    held = backtest.hold(backtest.target_weights(backtest.signal(base, backtest.CANDIDATES["S2_DONCH_N20"])))
    return rounded(held, ["asset", "day"], ["target", "held"])


# ---- whole back-tests

METRICS = ("ann_return", "ann_vol", "sharpe_ann", "max_dd", "cost_drag_ann", "gross_ann", "turnover_ann_oneway", "avg_exposure", "time_in_market")


@query(f"""WITH RECURSIVE {HELD}, {LEDGERS}, e AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY name ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM days),
    d AS (SELECT *, 1 - eq / max(eq) OVER (PARTITION BY name ORDER BY day ROWS UNBOUNDED PRECEDING) AS dd FROM e)
    SELECT name, round(avg(net) * 365, 4) AS ann_return, round(stddev_samp(net) * sqrt(365.0::DOUBLE), 4) AS ann_vol, round(coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) * sqrt(365.0::DOUBLE), 4) AS sharpe_ann, round(max(dd), 4) AS max_dd,
    round(avg(cost) * 365, 4) AS cost_drag_ann, round(avg(gross) * 365, 4) AS gross_ann, round(sum(turnover) / (count(*) / 365.0::DOUBLE), 4) AS turnover_ann_oneway, round(avg(exposure), 4) AS avg_exposure,
    round(avg((exposure > 1e-9)::INTEGER), 4) AS time_in_market, count(*) AS t_days FROM d GROUP BY 1""")
def backtest_candidates(spark, sf):
    """All candidates and the combination of three, in one pass."""
    out = backtest.metrics(backtest.run_all(_prices(spark, sf), backtest.CANDIDATES), ["name"])
    return rounded(out, ["name", "t_days"], list(METRICS), 4)


@query(f"WITH RECURSIVE {HELD}, {LEDGERS} SELECT day, round(gross, 6) AS gross, round(cost, 6) AS cost, round(with_yield, 6) AS net FROM days WHERE name = 'S1_SMA100_HOLD'")
def yield_ledger(spark, sf):
    """Idle cash earns a yearly rate that changes by month."""
    rate = F.month("day") * 0.004
    days = backtest.run_all(_prices(spark, sf), {"S1_SMA100_HOLD": backtest.CANDIDATES["S1_SMA100_HOLD"]}, yield_rate=rate)
    return rounded(days, ["day"], ["gross", "cost", "net"])


FIRST = "1-URGENT"


@query(f"SELECT day, round(ret - CASE WHEN i = 1 THEN 0.002::DOUBLE ELSE 0 END, 6) AS net FROM ({RETURNS}) WHERE asset = '{FIRST}'")
def buy_and_hold(spark, sf):
    return rounded(backtest.buy_and_hold(backtest.returns(_prices(spark, sf)), FIRST), ["day"], ["net"])


#: Two assets of tame returns, by which equal weights drift.
PAIR, TAME = ("1-URGENT", "2-HIGH"), "greatest(least(coalesce(ret, 0), 0.5), -0.5)"


@query(f"""WITH RECURSIVE g AS (SELECT DISTINCT day FROM ({PRICES}) WHERE asset IN {PAIR}), x AS (SELECT day, {TAME.replace("ret", "r1")} AS a, {TAME.replace("ret", "r2")} AS b FROM g
        LEFT JOIN (SELECT day, ret AS r1 FROM ({RETURNS}) WHERE asset = '{PAIR[0]}') USING (day) LEFT JOIN (SELECT day, ret AS r2 FROM ({RETURNS}) WHERE asset = '{PAIR[1]}') USING (day)),
    n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY day) AS i, date_trunc('month', day) <> date_trunc('month', coalesce(lag(day) OVER (ORDER BY day), day - INTERVAL 1 DAY)) AS sets FROM x),
    r AS (SELECT 0::BIGINT AS i, 0.5::DOUBLE AS v, NULL::DOUBLE AS net UNION ALL SELECT n.i, CASE WHEN sets THEN 0.5 ELSE w END,
        worth - 1 - CASE WHEN sets THEN 2 * abs(w - 0.5) * 0.002 ELSE 0 END - CASE WHEN n.i = 1 THEN 0.002 ELSE 0 END
        FROM (SELECT n.i, n.sets, r.v * (1 + a) + (1 - r.v) * (1 + b) AS worth, r.v * (1 + a) / (r.v * (1 + a) + (1 - r.v) * (1 + b)) AS w FROM r JOIN n ON n.i = r.i + 1) n)
    SELECT n.day, round(r.net, 6) AS net FROM r JOIN n USING (i)""")
def rebalanced_pair(spark, sf):
    """Equal weights of two assets that drift and are set back each month."""
    r = backtest.returns(_prices(spark, sf)).withColumn("ret", F.greatest(F.least("ret", F.lit(0.5)), F.lit(-0.5)))
    return rounded(backtest.rebalanced(r, PAIR), ["day"], ["net"])


#: Of the standard normal distribution, by Simpson's rule.
CDF = "(0.5 + {z} / 600 * list_sum(list_transform(range(0, 201), lambda i: (CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * i / 200, 2) / 2))) / sqrt(2 * pi()))"
EXPECTED = stats.expected_max_sharpe(7, 0.01)


@query(f"""WITH s AS (SELECT trial, count(*) AS t, avg(r) / stddev_samp(r) AS sr, avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5) AS skew, avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2) AS kurt
        FROM (SELECT *, avg(r) OVER (PARTITION BY trial) AS m FROM ({frames.TRIAL_RETURNS})) GROUP BY 1),
    z AS (SELECT trial, sr * sqrt(t - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS z, (sr - {EXPECTED!r}::DOUBLE) * sqrt(t - 1) / sqrt(greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) AS zd FROM s)
    SELECT trial, round({CDF.format(z="least(greatest(z, -8), 8)")}, 5) AS psr, round({CDF.format(z="least(greatest(zd, -8), 8)")}, 5) AS dsr FROM z""")
def sharpe_worth(spark, sf):
    """What each trial's Sharpe ratio is worth: the chance that it is above 0, and above the best of seven without skill."""
    skew, kurt = stats.moments(F.col("r"))
    s = frames.trial_returns(spark, sf).groupBy("trial").agg(F.count("*").alias("t"), stats.sharpe(F.col("r")).alias("sr"), skew.alias("skew"), kurt.alias("kurt"))
    worth = lambda at: F.round(stats.normal_cdf(stats.psr_z(F.col("sr"), F.col("t"), F.col("skew"), F.col("kurt"), at)), 5)
    return s.select("trial", worth(0.0).alias("psr"), worth(EXPECTED).alias("dsr"))


@query(f"""WITH t AS ({ORACLE["round_trips"]}) SELECT count(*) AS round_trips_total, round(count(*) * 365 / (SELECT count(DISTINCT date) FROM ({ORDER_BARS}))::DOUBLE, 6) AS round_trips_per_yr, round(avg((pnl > 0)::INTEGER), 6) AS hit_rate FROM t""")
def trip_metrics(spark, sf):
    from tideline.plans.queries import _held

    held = _held(spark, sf)
    days = held.select("day").distinct().count()
    return rounded(backtest.trip_metrics(backtest.round_trips(held).withColumn("pnl", F.round("pnl", 8)), days), ["round_trips_total"], ["round_trips_per_yr", "hit_rate"])
