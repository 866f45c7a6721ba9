"""Registered queries: the library's operators over the driver's tables, each with the same query in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import clock, stats, text
from tideline.operators import asof, bars, dedup, labels, matrix, merge, news, regime
from tideline.operators import windows as W
from tideline.plans import backtest, cv, dataset, frames, gates, overfit, training
from tideline.plans.frames import ARTICLES, CLOCKED, EVENT_BARS, INTERVALS, ORDER_BARS, REGIME_DAYS, TONE_ROWS, TRIAL_RETURNS, table
from tideline.session import shared_dir
from tideline.sources import contract, readers
from tideline.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOURLY, DAILY_EVENTS = EVENT_BARS.format(unit="hour"), EVENT_BARS.format(unit="day")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(v), digits).alias(v) for v in values])


# ---- bars and windows


@query(f"""SELECT event_type AS asset, date_trunc('day', ts)::TIMESTAMP AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume, count(*) AS n_bars, count(*) < 24 AS incomplete_day FROM events GROUP BY 1, 2""")
def daily_bars(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("asset"), F.col("ts").alias("open_time"), "event_id", *[F.col("value").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return bars.to_daily(e, tie="event_id").withColumn("volume", F.round("volume", 4))


@query(f"SELECT asset, date_trunc('day', open_time)::TIMESTAMP AS date, count(*) AS n_bars FROM ({HOURLY}) GROUP BY 1, 2 HAVING count(*) < 24")
def incomplete_days(spark, sf):
    return bars.to_daily(frames.event_bars(spark, sf)).where("incomplete_day").select("asset", "date", "n_bars")


@query(f"""SELECT * FROM (SELECT asset, lag(open_time) OVER w AS gap_start, open_time AS gap_end, date_diff('minute', lag(open_time) OVER w, open_time) AS gap_minutes
    FROM ({HOURLY}) WINDOW w AS (PARTITION BY asset ORDER BY open_time)) WHERE gap_minutes > 60""")
def gap_report(spark, sf):
    return W.gaps(frames.event_bars(spark, sf), "open_time", ["asset"], 60)


def _full(expr: str, n: int, agg: str) -> str:
    return f"CASE WHEN count({expr}) OVER w{n} = {n} THEN {agg}({expr}) OVER w{n} END"


def _windows(sizes, by="asset", order="date") -> str:
    return "WINDOW w AS (PARTITION BY {0} ORDER BY {1}), ".format(by, order) + ", ".join(f"w{n} AS (PARTITION BY {by} ORDER BY {order} ROWS {n - 1} PRECEDING)" for n in sizes)


R1 = "ln(close / lag(close, 1) OVER (PARTITION BY asset ORDER BY date))"


@query(f"""SELECT asset, date, round(ln(close / lag(close, 1) OVER w), 6) AS ret_1d, round(ln(close / lag(close, 21) OVER w), 6) AS ret_21d,
    round((close - ({_full('close', 20, 'avg')} - 2 * {_full('close', 20, 'stddev_samp')})) / (4 * {_full('close', 20, 'stddev_samp')} + 1e-12), 6) AS bb_pctb,
    round(4 * {_full('close', 20, 'stddev_samp')} / ({_full('close', 20, 'avg')} + 1e-12), 6) AS bb_bandwidth,
    round(close / {_full('close', 50, 'avg')} - 1, 6) AS px_vs_ma50, round(close / {_full('close', 200, 'avg')} - 1, 6) AS px_vs_ma200,
    round(close / {_full('close', 252, 'max')} - 1, 6) AS drawdown_252d, round((close - low) / (high - low + 1e-12), 6) AS close_in_range, round(ln(high / low), 6) AS range_1d,
    round((volume - {_full('volume', 21, 'avg')}) / ({_full('volume', 21, 'stddev_samp')} + 1e-12), 6) AS volume_z_21d,
    round(ti, 6) AS taker_imbalance, round({_full('ti', 5, 'avg')}, 6) AS taker_imbalance_5d, round({_full('am', 21, 'avg')} * 1e9, 4) AS amihud_21d
    FROM (SELECT *, (2 * taker_buy_base - volume) / (volume + 1e-12) AS ti, abs({R1}) / (quote_volume + 1.0) AS am FROM ({ORDER_BARS})) {_windows((5, 20, 21, 50, 200, 252))}""")
def price_block(spark, sf):
    out = bars.price_features(frames.order_bars(spark, sf))
    cols = ["ret_1d", "ret_21d", "bb_pctb", "bb_bandwidth", "px_vs_ma50", "px_vs_ma200", "drawdown_252d", "close_in_range", "range_1d", "volume_z_21d", "taker_imbalance", "taker_imbalance_5d", "amihud_21d"]
    return out.select("asset", "date", *[F.round(c, 4 if c == "amihud_21d" else 6).alias(c) for c in cols])


@query(f"""SELECT asset, date, round(sqrt({_full('hl', 21, 'avg')} / (4 * ln(2.0::DOUBLE))), 6) AS vol_parkinson_21d,
    round(sqrt(greatest({_full('gk', 21, 'avg')}, 0)), 6) AS vol_gk_21d
    FROM (SELECT *, pow(ln(high / low), 2) AS hl, 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0::DOUBLE) - 1) * pow(ln(close / open), 2) AS gk
        FROM (SELECT asset, date_trunc('day', open_time)::TIMESTAMP AS date, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close
              FROM (SELECT * REPLACE (open + 1 AS open, high + 1 AS high, low + 1 AS low, close + 1 AS close) FROM ({HOURLY})) GROUP BY 1, 2)) {_windows((21,))}""")
def range_volatility(spark, sf):
    b = frames.event_bars(spark, sf).withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    w = W.series(["asset"], "date")
    out = bars.to_daily(b)
    return out.select("asset", "date", F.round(bars.parkinson(21, w), 6).alias("vol_parkinson_21d"), F.round(F.coalesce(bars.garman_klass(21, w), F.when(F.row_number().over(w) >= 21, 0.0)), 6).alias("vol_gk_21d"))


ORACLE["range_volatility"] = ORACLE["range_volatility"].replace(f"greatest({_full('gk', 21, 'avg')}, 0)", f"CASE WHEN count(gk) OVER w21 = 21 THEN greatest({_full('gk', 21, 'avg')}, 0) END")


def _ewm(x: str, alpha: float) -> str:
    """The closed form, over i, the number of a row."""
    d = -math.log(1 - alpha)
    return f"(CASE WHEN {x} IS NOT NULL THEN sum({x} * exp(i * {d!r}::DOUBLE)) OVER u / sum(CASE WHEN {x} IS NOT NULL THEN exp(i * {d!r}::DOUBLE) END) OVER u END)"


U = "WINDOW w AS (PARTITION BY asset ORDER BY date), u AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)"
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) AS i, {R1} AS r FROM ({ORDER_BARS})"
_vol = {h: f"sqrt({_ewm('(r * r)', W.alpha_of(half_life=h))})" for h in (5, 21, 63)}


@query(f"""SELECT asset, date, round(v5, 6) AS vol_ewma_5d, round(v21, 6) AS vol_ewma_21d, round(v5 / (v63 + 1e-12), 6) AS vol_ratio_5_63,
    round({_full('v21', 21, 'stddev_samp')}, 6) AS vol_of_vol_21d, round((v21 - {_full('v21', 252, 'avg')}) / ({_full('v21', 252, 'stddev_samp')} + 1e-12), 5) AS vol_z_252d,
    round(ln(close / lag(close, 5) OVER w) / nullif(v21 * sqrt(5.0::DOUBLE), 0), 6) AS mom_voladj_5d
    FROM (SELECT asset, date, close, {_vol[5]} AS v5, {_vol[21]} AS v21, {_vol[63]} AS v63 FROM ({NUMBERED}) {U}) {_windows((21, 252))}""")
def ewm_volatility(spark, sf):
    out = bars.price_features(frames.order_bars(spark, sf))
    cols = ["vol_ewma_5d", "vol_ewma_21d", "vol_ratio_5_63", "vol_of_vol_21d", "vol_z_252d", "mom_voladj_5d"]
    return out.select("asset", "date", *[F.round(c, 5 if c == "vol_z_252d" else 6).alias(c) for c in cols])


def _rsi(n: int) -> str:
    up, down = (_ewm(f"(CASE WHEN d IS NOT NULL THEN greatest({s}d, 0) END)", 1 / n) for s in ("", "-"))
    return f"round(100 - 100 / (1 + {up} / ({down} + 1e-12)), 5) AS rsi_{n}"


@query(f"""SELECT asset, date, rsi_7, rsi_14, rsi_30, round((macd - {_ewm('macd', 0.2)}) / close, 6) AS macd_hist_norm
    FROM (SELECT *, {_rsi(7)}, {_rsi(14)}, {_rsi(30)}, {_ewm('close', W.alpha_of(span=12))} - {_ewm('close', W.alpha_of(span=26))} AS macd
          FROM (SELECT *, close - lag(close) OVER (PARTITION BY asset ORDER BY date) AS d FROM ({NUMBERED})) {U}) {U}""")
def rsi_macd(spark, sf):
    out = bars.price_features(frames.order_bars(spark, sf))
    return out.select("asset", "date", *[F.round(f"rsi_{n}", 5).alias(f"rsi_{n}") for n in (7, 14, 30)], F.round("macd_hist_norm", 6).alias("macd_hist_norm"))


@query(f"""SELECT asset, date_trunc('day', open_time)::TIMESTAMP AS date, round(sqrt(coalesce(sum(r * r), 0)), 6) AS vol_realized_1d
    FROM (SELECT *, ln(close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY open_time), 0)) AS r FROM (SELECT * REPLACE (close + 1 AS close) FROM ({HOURLY}))) GROUP BY 1, 2""")
def realized_volatility(spark, sf):
    out = bars.realized_from_intraday(frames.event_bars(spark, sf).withColumn("close", F.col("close") + 1))
    return out.select("asset", "date", F.round("vol_realized_1d", 6).alias("vol_realized_1d"))


def _z(x: str, n: int, name: str) -> str:
    return f"round(({x} - {_full(x, n, 'avg')}) / ({_full(x, n, 'stddev_samp')} + 1e-12), 5) AS {name}"


SHIPPED = "SELECT l_returnflag AS asset, l_shipdate AS t, l_orderkey * 10 + l_linenumber AS k, l_discount - 0.05::DOUBLE AS rate, l_quantity, l_extendedprice, l_tax FROM lineitem"


@query(f"""SELECT asset, date, round(f, 6) AS funding_1d, round(funding_last, 6) AS funding_last, {_z('f', 30, 'funding_z_30d')}, {_z('f', 90, 'funding_z_90d')},
    round({_full('f', 7, 'sum')}, 6) AS funding_7d_cum, round(f - lag(f, 7) OVER w, 6) AS funding_mom_7d
    FROM (SELECT asset, date_trunc('day', t)::TIMESTAMP AS date, sum(rate) AS f, arg_max(rate, (t, k)) AS funding_last FROM ({SHIPPED}) GROUP BY 1, 2) {_windows((7, 30, 90))}""")
def funding_block(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").alias("funding_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_discount") - 0.05).alias("funding_rate"))
    out = bars.funding_daily(rows, tie="k")
    return out.select("asset", "date", *[F.round(c, 5 if "_z_" in c else 6).alias(c) for c in ("funding_1d", "funding_last", "funding_z_30d", "funding_z_90d", "funding_7d_cum", "funding_mom_7d")])


@query(f"""SELECT asset, date, round(oi, 4) AS oi, round(top, 6) AS top_ls_pos_ratio, round(oi_usd / nullif(lag(oi_usd, 1) OVER w, 0) - 1, 6) AS oi_chg_1d, round(oi_usd / nullif(lag(oi_usd, 7) OVER w, 0) - 1, 6) AS oi_chg_7d,
    {_z('oi_usd', 90, 'oi_z_90d')}, {_z('top', 90, 'top_ls_pos_ratio_z_90d')}, top IS NULL AS positioning_missing
    FROM (SELECT asset, date_trunc('day', t)::TIMESTAMP AS date, arg_max(l_quantity, (t, k)) AS oi, arg_max(l_extendedprice, (t, k)) AS oi_usd, avg(l_tax) AS top FROM ({SHIPPED}) GROUP BY 1, 2) {_windows((90,))}""")
def positioning_block(spark, sf):
    tax = {c: F.col("l_tax") for c in bars.POSITIONING.values()}
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("asset"), F.col("l_shipdate").alias("create_time"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("sum_open_interest"), F.col("l_extendedprice").alias("sum_open_interest_value"), *[v.alias(k) for k, v in tax.items()])
    out = bars.metrics_daily(rows, tie="k")
    digits = {"oi": 4, "oi_z_90d": 5, "top_ls_pos_ratio_z_90d": 5}
    return out.select("asset", "date", *[F.round(c, digits.get(c, 6)).alias(c) for c in ("oi", "top_ls_pos_ratio", "oi_chg_1d", "oi_chg_7d", "oi_z_90d", "top_ls_pos_ratio_z_90d")], "positioning_missing")


@query(f"""SELECT asset, date, round(close / 100, 6) AS iv_30d, round((close - lag(close, 5) OVER w) / (lag(close, 5) OVER w + 1e-12), 6) AS iv_chg_5d, {_z('close', 90, 'iv_z_90d')},
    round((high - low) / (close + 1e-12), 6) AS iv_intraday_range FROM ({ORDER_BARS}) {_windows((90,))}""")
def implied_volatility_block(spark, sf):
    d = frames.order_bars(spark, sf).select("asset", F.col("date").alias("time"), *[F.col(c).alias(f"dvol_{c}") for c in ("open", "high", "low", "close")])
    return bars.dvol_daily(d).select("asset", "date", *[F.round(c, 5 if "_z_" in c else 6).alias(c) for c in ("iv_30d", "iv_chg_5d", "iv_z_90d", "iv_intraday_range")])


# ---- as-of joins and clocks

PURCHASES, VIEWS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'", "SELECT event_id AS view_id, user_id, ts AS view_ts, value AS view_value FROM events WHERE event_type = 'view'"


def _asof(spark, sf, bucket=None):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value"))
    out = asof.asof_backward(left, right, "ts", "view_ts", ["user_id"], bucket, tie="view_id")
    return out.select("event_id", "user_id", "ts", "matched.view_id", "matched.view_ts", "matched.view_value")


@query(f"SELECT p.event_id, p.user_id, p.ts, v.view_id, v.view_ts, v.view_value FROM ({PURCHASES}) p ASOF LEFT JOIN ({VIEWS}) v ON p.user_id = v.user_id AND p.ts >= v.view_ts")
def asof_purchase_view(spark, sf):
    return _asof(spark, sf)


@query(ORACLE["asof_purchase_view"])
def asof_bucketed(spark, sf):
    return _asof(spark, sf, bucket=3 * 86_400)


@query(f"""SELECT p.event_id, p.user_id, date_diff('minute', v.view_ts, p.ts) - CASE WHEN v.view_ts + date_diff('minute', v.view_ts, p.ts) * INTERVAL 1 MINUTE > p.ts THEN 1 ELSE 0 END AS age_minutes,
    CASE WHEN coalesce((date_diff('minute', v.view_ts, p.ts) - CASE WHEN v.view_ts + date_diff('minute', v.view_ts, p.ts) * INTERVAL 1 MINUTE > p.ts THEN 1 ELSE 0 END) / 60.0 <= 48, true) THEN v.view_value END AS view_value
    FROM ({PURCHASES}) p ASOF LEFT JOIN ({VIEWS}) v ON p.user_id = v.user_id AND p.ts >= v.view_ts""")
def asof_stale_cap(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("decision_day"))
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("published_at"), "value")
    out = asof.asof_published(left, right, ["value"], "view", 48, ["user_id"])
    return out.select("event_id", "user_id", F.round(F.col("view_age_h") * 60).cast("long").alias("age_minutes"), "view_value")


@query(f"SELECT url_hash, revision_no, pit_usable_at, usable_at, usable_at <= pit_usable_at + INTERVAL 7 DAY AS in_time, usable_at <= TIMESTAMP '2024-01-15' AND usable_at > TIMESTAMP '2024-01-14' AS selected FROM ({CLOCKED})")
def usable_clock(spark, sf):
    a = frames.articles(spark, sf)
    a = a.withColumn("pit_usable_at", clock.usable_at(F.col("published_at_utc"), F.col("first_seen_at_utc"), F.col("backfilled")))
    a = a.withColumn("usable_at", F.greatest("pit_usable_at", F.col("scored_at_utc") + F.expr("interval 5 minutes")))
    at = F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz")
    return a.select("url_hash", "revision_no", "pit_usable_at", "usable_at", clock.not_late(F.col("usable_at"), F.col("pit_usable_at")).alias("in_time"), clock.is_usable(F.col("usable_at"), at).alias("selected"))


# ---- merges


@query("""SELECT url_hash, revision_no FROM (SELECT user_id::VARCHAR AS url_hash, event_id::INTEGER AS revision_no, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
    FROM events WHERE event_id % 11 <> 0 AND (event_id % 5 = 0 OR event_id % 3 <> 2)) WHERE n = 1""")
def latest_revision(spark, sf):
    a = frames.articles(spark, sf)
    keys = ["url_hash", "revision_no"]
    scores = a.select(*keys, "model", "assets", "duplicate_of")
    return news.latest_scored(a.select(*keys, "published_at_utc"), scores, "btc").select(*keys)


@query("""SELECT user_id, ts, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS revision_no, CASE WHEN before IS NULL THEN 'new' ELSE 'revision' END AS status
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def revisions(spark, sf):
    out = merge.revisions(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])
    return out.select("user_id", "ts", "event_type", F.col("revision_no").cast("int").alias("revision_no"), "status")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN -o_totalprice ELSE o_totalprice END AS price, o_orderstatus <> 'F' AS fresh FROM orders""")
def merge_keep_last(spark, sf):
    """Finished and pending orders were known before; open and pending ones come new."""
    o = table(spark, sf, "orders")
    old = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(False).alias("fresh"))
    new = o.where("o_orderstatus <> 'F'").select("o_orderkey", (-F.col("o_totalprice")).alias("price"), F.lit(True).alias("fresh"))
    return merge.merge(old, new, ["o_orderkey"], "last")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE -o_totalprice END AS price FROM orders""")
def merge_keep_first(spark, sf):
    o = table(spark, sf, "orders")
    old, new = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_totalprice").alias("price")), o.where("o_orderstatus <> 'F'").select("o_orderkey", (-F.col("o_totalprice")).alias("price"))
    return merge.merge(old, new, ["o_orderkey"], "first")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_pending(spark, sf):
    return merge.not_in(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""SELECT coalesce(a.day, b.day) AS day, a.orders, b.shipped FROM (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1) a
    FULL JOIN (SELECT l_shipdate::DATE AS day, count(*) AS shipped FROM lineitem GROUP BY 1) b ON a.day = b.day""")
def full_join_coalesce(spark, sf):
    a = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    b = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("shipped"))
    return a.join(b, "day", "full")


@query("""SELECT n_nationkey AS k, n_name AS name, n_regionkey::DOUBLE AS region, NULL::DOUBLE AS balance FROM nation UNION ALL
    SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def union_diagonal(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("region"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def top_by_rank(spark, sf):
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("n", n).where("n <= 5").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("""WITH r AS (SELECT event_type AS feed_name, ts AS t, CASE WHEN event_id % 3 <> 0 THEN 'e' || (event_id % 7) END AS error, 'tag' || event_id AS etag FROM events),
    k AS (SELECT feed_name, max(t) FILTER (WHERE error IS NULL) AS last_ok, arg_max(etag, t) FILTER (WHERE error IS NULL) AS etag FROM r GROUP BY 1)
    SELECT feed_name, any_value(k.etag) AS etag, any_value(last_ok) AS last_ok, arg_max(error, t) FILTER (WHERE error IS NOT NULL AND (last_ok IS NULL OR t > last_ok)) AS last_error,
    count(*) FILTER (WHERE error IS NOT NULL AND (last_ok IS NULL OR t > last_ok)) AS error_count FROM r JOIN k USING (feed_name) GROUP BY 1""")
def feed_state(spark, sf):
    n = F.col("event_id")
    runs = table(spark, sf, "events").select(F.col("event_type").alias("feed_name"), F.col("ts").alias("t"), F.concat(F.lit("tag"), n).alias("etag"), F.lit("m").alias("modified"), F.when(n % 3 != 0, F.concat(F.lit("e"), n % 7)).alias("error"))
    return merge.feed_state(runs, at="t").drop("modified")


# ---- news

CONF = "coalesce(confidence, 0.5)"


def _fan(rows: str, usable: str = "usable_at") -> str:
    return f"""SELECT * FROM (SELECT *, (date_diff('second', {usable}, decision_day) - CASE WHEN {usable} + date_diff('second', {usable}, decision_day) * INTERVAL 1 SECOND > decision_day THEN 1 ELSE 0 END) / 3600.0::DOUBLE AS age_h
        FROM (SELECT *, unnest(generate_series(date_trunc('day', {usable}) + INTERVAL 1 DAY, {usable} + INTERVAL 7 DAY, INTERVAL 1 DAY))::TIMESTAMP AS decision_day FROM ({rows}))) WHERE age_h > 0"""


def _decay(v: str, w: str, h: float) -> str:
    x = f"({w}) * exp({-math.log(2) / h!r}::DOUBLE * age_h)"
    return f"coalesce(sum(({v}) * {x}), 0) / (sum({x}) + 1e-12)"


LATEST = f"""SELECT * FROM (SELECT *, duplicate_of IS NOT NULL AS is_dup FROM ({CLOCKED}) WHERE model <> 'failed' AND (assets LIKE '%BTC%' OR duplicate_of IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY revision_no DESC) = 1) WHERE usable_at <= pit_usable_at + INTERVAL 7 DAY"""
SENT = "NOT is_dup AND NOT is_price_report"


@query(f"""WITH e AS ({_fan(LATEST)}),
    s AS (SELECT decision_day, {", ".join(f"round({_decay('sentiment', CONF, h)}, 6) AS news_sent_{k}" for k, h in news.HALF_LIVES.items())},
        round(sum((sentiment < -0.15)::INTEGER * {CONF}) / (sum({CONF}) + 1e-12), 6) AS news_neg_share, round(stddev_samp(sentiment), 6) AS news_dispersion, max(severity) AS news_max_severity
        FROM e WHERE {SENT} GROUP BY 1),
    v AS (SELECT decision_day, count(*) AS news_count_24h, round(avg((NOT is_dup)::INTEGER), 6) AS news_novel_share FROM e WHERE age_h <= 24 GROUP BY 1),
    t AS (SELECT decision_day, {", ".join(f"round(sum(severity * {CONF}) FILTER (event_type = '{x}'), 6) AS evt_{x}" for x in news.EVENT_TYPES)}
        FROM e WHERE age_h <= 24 AND NOT is_dup GROUP BY 1)
    SELECT decision_day, * EXCLUDE (decision_day), 1 AS era_llm FROM s FULL JOIN v USING (decision_day) LEFT JOIN t USING (decision_day)""")
def scored_news_daily(spark, sf):
    a = frames.articles(spark, sf)
    keys = ["url_hash", "revision_no"]
    mine = ["published_at_utc", "first_seen_at_utc", "backfilled"]
    rows = news.with_clock(news.latest_scored(a.select(*keys, *mine), a.drop(*mine), "btc"))
    out = news.scored_daily(rows)
    exact = {"decision_day", "news_max_severity", "news_count_24h", "era_llm"}
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


def _theme(bucket: str) -> str:
    return "avg(CASE WHEN age_h <= 24 THEN (" + " OR ".join(f"contains(coalesce(themes, ''), '{m}')" for m in news.THEMES[bucket]) + ")::INTEGER END)"


@query(f"""WITH e AS ({_fan(f"SELECT *, file_time + INTERVAL 30 MINUTE AS usable_at FROM ({TONE_ROWS})")})
    SELECT decision_day, {", ".join(f"round({_decay('tone / 10', '1.0::DOUBLE', h)}, 6) AS news_sent_{k}" for k, h in news.HALF_LIVES.items())}, round(avg((tone / 10 < -0.2)::INTEGER), 6) AS news_neg_share,
    round(stddev_samp(tone / 10), 6) AS news_dispersion, round(avg(positive), 6) AS gdelt_pos_mag, round(avg(negative), 6) AS gdelt_neg_mag, round(avg(n_themes), 6) AS gdelt_complexity,
    nullif(count(*) FILTER (age_h <= 24), 0) AS news_count_24h, {", ".join(f"round({_theme(b)}, 6) AS gdelt_theme_{b}" for b in news.THEMES)}, 0 AS era_llm FROM e GROUP BY 1""")
def tone_news_daily(spark, sf):
    out = news.tone_daily(frames.tone_rows(spark, sf))
    exact = {"decision_day", "news_count_24h", "era_llm"}
    return out.select(*[c if c in exact else F.round(c, 6).alias(c) for c in out.columns])


@query("""SELECT day, asset, n, era FROM (SELECT day, asset, n, era, row_number() OVER (PARTITION BY asset, day ORDER BY era) AS k FROM (
    SELECT o_orderdate::DATE AS day, o_orderpriority AS asset, count(*) AS n, 0 AS era FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL
    SELECT o_orderdate::DATE, o_orderpriority, count(*), 1 FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)) WHERE k = 1""")
def era_cut_over(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda c, era: o.where(c).groupBy(F.to_date("o_orderdate").alias("decision_day"), F.col("o_orderpriority").alias("asset")).agg(F.count("*").alias("n")).withColumn("era_llm", F.lit(era))
    return news.cut_over(part("o_orderstatus = 'F'", 0), part("o_orderstatus <> 'F'", 1), ["asset"]).select(F.col("decision_day").alias("day"), "asset", "n", F.col("era_llm").alias("era"))


DENSE = """SELECT c.asset, c.day, coalesce(n, 0)::BIGINT AS n FROM (SELECT asset, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM ({0}) GROUP BY asset) c LEFT JOIN ({0}) d ON c.asset = d.asset AND c.day = d.day""".format("SELECT o_orderpriority AS asset, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2")


@query(f"""SELECT asset, day, n, round(ln(1 + n) - ln(1 + CASE WHEN count(b) OVER w8 = 8 THEN quantile_cont(b, 0.5) OVER w8 END), 6) AS news_attn_abnormal,
    n < CASE WHEN count(b) OVER w8 = 8 THEN list_sort(list(b) OVER w8)[2] END AS low_news_flag
    FROM (SELECT *, dayofweek(day) AS dow, lag(n::DOUBLE) OVER (PARTITION BY asset, dayofweek(day) ORDER BY day) AS b FROM ({DENSE})) WINDOW w8 AS (PARTITION BY asset, dow ORDER BY day ROWS 7 PRECEDING)""")
def abnormal_attention(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return news.abnormal_attention(d, "n", ["asset"], "day").select("asset", "day", "n", F.round("news_attn_abnormal", 6).alias("news_attn_abnormal"), "low_news_flag")


@query(DENSE)
def densify(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return W.densify(d, "day", ["asset"], {"n": 0}).select("asset", "day", "n")


@query("""SELECT event_type, round(avg(CASE WHEN contains(props, '"a') THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n FROM events GROUP BY 1""")
def keyword_share(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(text.contains_any(F.col("props"), ['"a']).cast("double")), 6).alias("share"), F.count("*").alias("n"))


# ---- regime


@query(f"""SELECT (date + INTERVAL 1 DAY)::DATE AS decision_day, {", ".join(f"quantile_cont({c}, 0.5) OVER w3 AS regime_{c}" for c in ("risk_appetite", "crypto_stress", "macro_stress"))},
    CASE WHEN date_diff('day', lag(date) OVER w, date) <= 1 THEN risk_appetite - lag(risk_appetite) OVER w END AS regime_ra_delta, confidence AS regime_confidence,
    date_diff('day', lag(date) OVER w, date)::INTEGER AS regime_gap_days FROM ({REGIME_DAYS})
    WINDOW w AS (ORDER BY date), w3 AS (ORDER BY date RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW)""")
def regime_smoothed(spark, sf):
    return regime.smoothed(frames.regime_days(spark, sf))


@query(f"""SELECT from_state, to_state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY from_state), 6) AS share FROM
    (SELECT lag(crypto_stress) OVER w AS from_state, crypto_stress AS to_state, date_diff('day', lag(date) OVER w, date) AS gap FROM ({REGIME_DAYS}) WINDOW w AS (ORDER BY date)) WHERE gap = 1 GROUP BY 1, 2""")
def regime_transitions(spark, sf):
    return regime.transitions(frames.regime_days(spark, sf), "crypto_stress", "date").withColumn("share", F.round("share", 6))


RUNS = "SELECT run, any_value(s) AS value, count(*) AS length FROM (SELECT s, sum(CASE WHEN s = b THEN 0 ELSE 1 END) OVER (ORDER BY date) AS run FROM (SELECT date, sign(risk_appetite)::INTEGER AS s, lag(sign(risk_appetite)::INTEGER) OVER (ORDER BY date) AS b FROM ({0}))) GROUP BY run".format(REGIME_DAYS)


@query(f"SELECT run::BIGINT AS run, value, length FROM ({RUNS})")
def run_lengths(spark, sf):
    d = frames.regime_days(spark, sf).withColumn("s", F.signum(F.col("risk_appetite").cast("double")).cast("int"))
    return regime.run_lengths(d, "s", "date")


# ---- labels

BAR_IDX = f"SELECT *, row_number() OVER (PARTITION BY asset ORDER BY open_time) - 1 AS idx FROM (SELECT * REPLACE (high + 50 AS high, low + 50 AS low, close + 50 AS close) FROM ({HOURLY}))"
SIGMA = f"SELECT asset, idx, high, low, close, CASE WHEN count(r) OVER w24 = 24 THEN stddev_samp(r) OVER w24 END AS sigma FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY idx)) AS r FROM ({BAR_IDX})) WINDOW w24 AS (PARTITION BY asset ORDER BY idx ROWS 23 PRECEDING)"
HORIZON, MULT = 24, 1.5


def _bars(spark, sf) -> DataFrame:
    b = frames.event_bars(spark, sf).withColumns({c: F.col(c) + 50 for c in ("high", "low", "close")})
    b = labels.numbered(b, ["asset"], "open_time")
    w = W.series(["asset"], "idx")
    return b.select("asset", "idx", "high", "low", "close", W.logret(F.col("close"), 1, w).alias("r")).withColumn("sigma", W.rolling_std(F.col("r"), 24, w)).drop("r")


def _events(spark, sf) -> DataFrame:
    cfg = labels.Barriers(MULT, MULT, HORIZON)
    b = _bars(spark, sf)
    return labels.triple_barrier(b.where("idx % 5 = 0").select("asset", "idx"), b, cfg)


TOUCHED = f"""WITH b AS ({SIGMA}), t AS (SELECT asset, idx AS t0, close AS p0, sigma AS trgt, close * (1 + {MULT} * sigma) AS up, close * (1 - {MULT} * sigma) AS dn FROM b WHERE idx % 5 = 0 AND sigma >= 1e-4),
    x AS (SELECT t.asset, t.t0, any_value(t.p0) AS p0, any_value(t.trgt) AS trgt, any_value(up) AS up, any_value(dn) AS dn, count(*) AS n,
        min(CASE WHEN b.idx > t0 AND high >= up THEN b.idx END) AS iu, min(CASE WHEN b.idx > t0 AND low <= dn THEN b.idx END) AS id, max(CASE WHEN b.idx = t0 + {HORIZON} THEN b.close END) AS last
        FROM t JOIN b ON t.asset = b.asset AND b.idx BETWEEN t.t0 AND t.t0 + {HORIZON} GROUP BY 1, 2),
    y AS (SELECT *, CASE WHEN iu IS NULL AND id IS NULL THEN 'vertical' WHEN id IS NULL OR iu < id THEN 'up' ELSE 'down' END AS touch FROM x WHERE n = {HORIZON + 1})
    SELECT asset, t0 AS t0_idx, CASE touch WHEN 'up' THEN iu WHEN 'down' THEN id ELSE t0 + {HORIZON} END AS t1_idx,
    CASE touch WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE sign(last / p0 - 1)::INTEGER END AS label, CASE touch WHEN 'up' THEN up WHEN 'down' THEN dn ELSE last END / p0 - 1 AS ret, trgt, touch FROM y"""


@query(f"SELECT asset, t0_idx, t1_idx, label, round(ret, 6) AS ret, round(trgt, 6) AS trgt, touch FROM ({TOUCHED})")
def triple_barrier(spark, sf):
    return _events(spark, sf).select("asset", "t0_idx", "t1_idx", "label", F.round("ret", 6).alias("ret"), F.round("trgt", 6).alias("trgt"), "touch")


COVER = f"""WITH ev AS ({TOUCHED}), b AS ({SIGMA}) SELECT b.asset, b.idx, count(ev.t0_idx)::BIGINT AS c FROM b LEFT JOIN ev ON ev.asset = b.asset AND b.idx BETWEEN ev.t0_idx AND ev.t1_idx
    WHERE b.asset IN (SELECT asset FROM ev) GROUP BY 1, 2"""


@query(COVER)
def concurrency(spark, sf):
    return labels.concurrency(_events(spark, sf), _bars(spark, sf))


@query(f"""WITH c AS ({COVER}), ev AS ({TOUCHED}), r AS (SELECT asset, idx, coalesce(ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY idx)), 0) AS r FROM ({SIGMA})),
    s AS (SELECT ev.asset, t0_idx, t1_idx, avg(1.0::DOUBLE / greatest(c, 1)) AS u, abs(sum(r / greatest(c, 1))) AS raw FROM ev JOIN c ON c.asset = ev.asset AND c.idx BETWEEN t0_idx AND t1_idx JOIN r ON r.asset = c.asset AND r.idx = c.idx GROUP BY 1, 2, 3),
    d AS (SELECT *, raw * count(*) OVER a / greatest(sum(raw) OVER a, 1e-12) AS wa, greatest(1 - 0.25 / sum(u) OVER a * sum(u) OVER a + 0.25 / sum(u) OVER a * sum(u) OVER (PARTITION BY asset ORDER BY t1_idx, t0_idx ROWS UNBOUNDED PRECEDING), 0) AS wd FROM s WINDOW a AS (PARTITION BY asset))
    SELECT asset, t0_idx, t1_idx, round(u, 6) AS uniqueness, round(wa, 6) AS w_attrib, round(wd, 6) AS w_decay, round(greatest(wa * wd, 1e-3 * avg(wa * wd) OVER (PARTITION BY asset)), 6) AS sample_weight FROM d""")
def sample_weights(spark, sf):
    out = labels.sample_weights(_events(spark, sf), _bars(spark, sf))
    return out.select("asset", "t0_idx", "t1_idx", *[F.round(c, 6).alias(c) for c in ("uniqueness", "w_attrib", "w_decay", "sample_weight")])


@query(f"""WITH RECURSIVE b AS (SELECT asset, idx, ln(close) - ln(lag(close) OVER (PARTITION BY asset ORDER BY idx)) AS r, sigma FROM ({SIGMA})),
    s AS (SELECT asset, 0::BIGINT AS idx, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n, false AS fired FROM b WHERE idx = 0 UNION ALL
        SELECT asset, idx, CASE WHEN up >= h THEN 0 ELSE up END, CASE WHEN NOT coalesce(up >= h, false) AND dn <= -h THEN 0 ELSE dn END, coalesce(up >= h OR dn <= -h, false) FROM (
            SELECT b.asset, b.idx, CASE WHEN b.r IS NULL THEN 0 ELSE greatest(0, s.p + b.r) END AS up, CASE WHEN b.r IS NULL THEN 0 ELSE least(0, s.n + b.r) END AS dn, CASE WHEN b.r IS NOT NULL THEN b.sigma END AS h
            FROM s JOIN b ON b.asset = s.asset AND b.idx = s.idx + 1))
    SELECT asset, idx FROM s WHERE fired""")
def cusum_events(spark, sf):
    return labels.cusum_events(_bars(spark, sf), [1.0]).select("asset", "idx")


# ---- matrix and training frames

ONCHAIN = "SELECT date + INTERVAL 1 DAY + INTERVAL 6 HOUR AS published_at, asset, round(avg(volume), 6) AS tx FROM ({0}) WHERE (epoch(date)::BIGINT // 86400) % 4 <> 0 GROUP BY date, asset".format(ORDER_BARS)


@query(f"""WITH d AS ({ORDER_BARS}), s AS (SELECT asset, date, (date + INTERVAL 1 DAY)::TIMESTAMP AS decision_day, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS ret_1d FROM d),
    f AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS date, sum(l_discount - 0.05::DOUBLE) AS funding_1d FROM lineitem GROUP BY 1),
    o AS ({ONCHAIN})
    SELECT s.asset, s.decision_day, round(ret_1d, 6) AS ret_1d, round(funding_1d, 6) AS funding_1d, round(CASE WHEN coalesce(date_diff('minute', o.published_at, s.decision_day) / 60.0 <= 48, true) THEN tx END, 6) AS oc_tx,
    date_diff('minute', o.published_at, s.decision_day) / 60.0::DOUBLE AS oc_age_h FROM s LEFT JOIN f ON f.date + INTERVAL 1 DAY = s.decision_day
    ASOF LEFT JOIN o ON o.asset = s.asset AND s.decision_day >= o.published_at""")
def feature_matrix(spark, sf):
    daily = frames.order_bars(spark, sf)
    w = W.series(["asset"], "date")
    spine = daily.select("asset", "date", W.logret(F.col("close"), 1, w).alias("ret_1d"))
    rows = table(spark, sf, "lineitem").select(F.lit("A").alias("k"), F.col("l_shipdate").alias("funding_time"), (F.col("l_discount") - 0.05).alias("funding_rate"))
    funding = bars.funding_daily(rows, ["k"]).select("date", "funding_1d")
    every = daily.select("asset").distinct()
    chain = daily.where("(unix_date(to_date(date))) % 4 <> 0").groupBy("date", "asset").agg(F.round(F.avg("volume"), 6).alias("tx")).select("asset", (F.col("date") + F.expr("interval 1 day 6 hours")).alias("published_at"), "tx")
    out = matrix.assemble(spine, {"funding": funding.crossJoin(F.broadcast(every))}, [matrix.Published(chain, ["tx"], "oc", 48)])
    return out.select("asset", "decision_day", *[F.round(c, 6).alias(c) for c in ("ret_1d", "funding_1d", "oc_tx")], "oc_age_h")


@query(f"""SELECT e.event_id, e.asset, e.t0_time, m.decision_day, round(m.close, 6) AS feat FROM (SELECT event_id, event_type AS asset, ts AS t0_time FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25') e
    ASOF LEFT JOIN (SELECT asset, open_time + INTERVAL 1 DAY AS decision_day, close FROM ({DAILY_EVENTS})) m ON m.asset = e.asset AND e.t0_time >= m.decision_day""")
def training_frame(spark, sf):
    ev = table(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-03'").select("event_id", F.col("event_type").alias("asset"), F.col("ts").alias("t0_time"))
    m = frames.event_bars(spark, sf, "day").select("asset", (F.col("open_time") + F.expr("interval 1 day")).alias("decision_day"), F.col("close").alias("feat"))
    out, _ = dataset.training_frame(ev, m, lockbox="2024-01-25", check=False)
    return out.select("event_id", "asset", "t0_time", "decision_day", F.round("feat", 6).alias("feat"))


@query(f"""SELECT asset, date, round(list_sum(w), 6) AS total, w[1] AS first, len(w) AS n FROM (SELECT asset, date, list_concat(list_resize([]::DOUBLE[], greatest(0, 8 - len(g)), 0.0), g) AS w
    FROM (SELECT asset, date, list(close) OVER (PARTITION BY asset ORDER BY date ROWS 7 PRECEDING) AS g FROM ({ORDER_BARS})))""")
def sequence_windows(spark, sf):
    out = dataset.sequences(frames.order_bars(spark, sf), "close", 8)
    return out.select("asset", "date", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.col("window")[0].alias("first"), F.size("window").cast("long").alias("n"))


@query()
def purged_model_folds(spark, sf):
    """Boosted trees of the library's ML part by purged folds; which events a fold trains and tests on is the query after this."""
    e = table(spark, sf, "events")
    h = lambda i: F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(1000)) / 1000.0
    f = e.select("event_id", F.col("event_type").alias("asset"), F.col("ts").alias("t0_time"), (F.col("ts") + F.expr("interval 3 hours")).alias("t1_time"), F.col("value").alias("ret_1d"), h(1).alias("rsi_7"), (h(2) - 0.5).alias("ret"), F.lit(1.0).alias("sample_weight"))
    f = f.withColumn("label", (F.col("ret_1d") / 100 + h(3) > 0.9).cast("int"))
    return training.evaluate(f, ["ret_1d", "rsi_7"], {"maxIter": 3, "featureSubsetStrategy": "all", "minInstancesPerNode": 10}, folds=3, embargo="interval 6 hours")


@query("""WITH e AS (SELECT event_id, ts AS t0, ts + INTERVAL 3 HOUR AS t1, ntile(3) OVER (ORDER BY ts, event_id) - 1 AS fold FROM events), f AS (SELECT fold AS split, min(t0) AS s, max(t1) AS z FROM e GROUP BY 1)
    SELECT split::INTEGER AS split, CASE WHEN fold = split THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM e, f
    WHERE fold = split OR NOT ((t0 <= z AND t1 >= s) OR (t0 > z AND t0 <= z + INTERVAL 6 HOUR)) GROUP BY 1, 2""")
def purged_fold_sizes(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("t0"), (F.col("ts") + F.expr("interval 3 hours")).alias("t1"))
    return cv.purged_kfold(e, 3, "interval 6 hours").groupBy("split", "role").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(1 - CASE WHEN x < 0 THEN 0.1 WHEN x >= 4 THEN 0.9 ELSE 0.1 + 0.2 * floor(x) + 0.2 * (x - floor(x)) END, 6) AS p_up FROM (SELECT o_orderkey, o_totalprice % 6 - 1 AS x FROM orders)""")
def probability_up(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") % 6 - 1).alias("x")).withColumn("q", F.array(*[F.lit(float(i)) for i in range(5)]))
    return o.select("o_orderkey", F.round(training.probability_up([0.1, 0.3, 0.5, 0.7, 0.9], "q", "x"), 6).alias("p_up"))


# ---- cross-validation and statistics

EMB = "INTERVAL 22 DAY"


@query(f"""WITH e AS (SELECT id, t0, t1, ntile(5) OVER (ORDER BY t0, id) - 1 AS fold FROM ({INTERVALS})), f AS (SELECT fold AS split, min(t0) AS s, max(t1) AS z FROM e GROUP BY 1)
    SELECT split::INTEGER AS split, id, CASE WHEN fold = split THEN 'test' ELSE 'train' END AS role FROM e, f
    WHERE fold = split OR NOT ((t0 <= z AND t1 >= s) OR (t0 > z AND t0 <= z + {EMB}))""")
def purged_kfold(spark, sf):
    return cv.purged_kfold(frames.intervals(spark, sf))


@query(f"""WITH e AS (SELECT id, t0, t1, ntile(6) OVER (ORDER BY t0, id) - 1 AS fold FROM ({INTERVALS})), f AS (SELECT fold, min(t0) AS s, max(t1) AS z FROM e GROUP BY 1),
    c AS (SELECT a.fold AS a, b.fold AS b, (row_number() OVER (ORDER BY a.fold, b.fold) - 1)::INTEGER AS split FROM f a JOIN f b ON a.fold < b.fold),
    p AS (SELECT split, id, bool_or(e.fold = f.fold) AS test, bool_or((t0 <= z AND t1 >= s) OR (t0 > z AND t0 <= z + {EMB})) AS bad FROM c JOIN f ON f.fold IN (a, b), e GROUP BY 1, 2)
    SELECT split, id, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM p WHERE test OR NOT bad""")
def cpcv_splits(spark, sf):
    return cv.cpcv(frames.intervals(spark, sf))


RANKS = "(rank() OVER (PARTITION BY asset ORDER BY {0}) + (count(*) OVER (PARTITION BY asset, {0}) - 1) / 2.0)"


@query(f"SELECT asset, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT asset, {RANKS.format('trades')} AS rx, {RANKS.format('close')} AS ry FROM ({HOURLY})) GROUP BY 1")
def spearman(spark, sf):
    return stats.spearman(frames.event_bars(spark, sf), "trades", "close", ["asset"]).withColumn("rho", F.round("rho", 6))


@query(f"""SELECT asset, round((sum(r) FILTER (l = 1) - count(*) FILTER (l = 1) * (count(*) FILTER (l = 1) + 1) / 2.0) / (count(*) FILTER (l = 1) * count(*) FILTER (l = 0)), 6) AS auc
    FROM (SELECT asset, (close > 50)::INTEGER AS l, {RANKS.format('trades')} AS r FROM ({HOURLY})) GROUP BY 1""")
def auc(spark, sf):
    b = frames.event_bars(spark, sf).withColumn("l", (F.col("close") > 50).cast("int"))
    return stats.auc(b, "trades", "l", ["asset"]).withColumn("auc", F.round("auc", 6))


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY date) AS i, (rank() OVER (ORDER BY crypto_stress) + (count(*) OVER (PARTITION BY crypto_stress) - 1) / 2.0) AS rx,
    (rank() OVER (ORDER BY macro_stress) + (count(*) OVER (PARTITION BY macro_stress) - 1) / 2.0) AS ry FROM ({REGIME_DAYS})), n AS (SELECT count(*) AS n FROM r), k AS (SELECT unnest([0, 1, 7, 30, 365]) AS k)
    SELECT k::INTEGER AS k, round(corr(a.rx, b.ry), 6) AS rho FROM k, n, r a JOIN r b ON b.i = (a.i - 1 + k) % n + 1 GROUP BY 1""")
def rotation_correlations(spark, sf):
    return gates.rotation_correlations(frames.regime_days(spark, sf), "crypto_stress", "macro_stress", "date", [0, 1, 7, 30, 365]).withColumn("rho", F.round("rho", 6))


@query(f"""SELECT count(*) FILTER (risk_appetite <= -1) AS n_low, count(*) FILTER (risk_appetite >= 1) AS n_high, round(avg(confidence) FILTER (risk_appetite <= -1), 6) AS mean_low, round(avg(confidence) FILTER (risk_appetite >= 1), 6) AS mean_high,
    round((avg(confidence) FILTER (risk_appetite <= -1) - avg(confidence) FILTER (risk_appetite >= 1)) / sqrt(var_samp(confidence) FILTER (risk_appetite <= -1) / count(*) FILTER (risk_appetite <= -1) + var_samp(confidence) FILTER (risk_appetite >= 1) / count(*) FILTER (risk_appetite >= 1)), 6) AS t FROM ({REGIME_DAYS})""")
def welch(spark, sf):
    return rounded(gates.welch(frames.regime_days(spark, sf), "confidence", F.col("risk_appetite") <= -1, F.col("risk_appetite") >= 1), ["n_low", "n_high"], ["mean_low", "mean_high", "t"])


LOCAL_BARS = f"SELECT asset, open_time, close + 50 AS close, ln((close + 50) / lag(close + 50) OVER (PARTITION BY asset ORDER BY open_time)) AS r FROM ({HOURLY})"


@query(f"""WITH b AS ({LOCAL_BARS}), c AS (SELECT asset, unnest(generate_series(min(open_time)::DATE, max(open_time)::DATE, INTERVAL 1 DAY))::DATE AS date FROM b GROUP BY 1),
    x AS (SELECT c.asset, c.date, b.open_time, b.r, 1 - b.close / max(b.close) OVER (PARTITION BY c.asset, c.date ORDER BY b.open_time) AS dd FROM c JOIN b ON b.asset = c.asset AND b.open_time >= c.date + INTERVAL 1 DAY AND b.open_time < c.date + INTERVAL 8 DAY),
    s AS (SELECT asset, date, count(*) AS n, sqrt(sum(coalesce(r, 0) * coalesce(r, 0))) AS v, max(dd) AS dd FROM x GROUP BY 1, 2)
    SELECT c.asset, c.date, round(CASE WHEN n >= 100 THEN v END, 6) AS fwd_vol_7d, round(CASE WHEN n >= 100 THEN dd END, 6) AS fwd_maxdd_7d, coalesce(n, 0) AS fwd_n_bars FROM c LEFT JOIN s ON s.asset = c.asset AND s.date = c.date""")
def forward_outcomes(spark, sf):
    b = frames.event_bars(spark, sf).withColumn("close", F.col("close") + 50)
    return rounded(gates.forward_outcomes(b, ["asset"], least=100), ["asset", "date", "fwd_n_bars"], ["fwd_vol_7d", "fwd_maxdd_7d"])


@query(f"""SELECT trial, count(*) AS n, round(coalesce(avg(r) / nullif(stddev_samp(r), 0), 0), 6) AS sharpe, round(avg(pow(r - m, 3)) / pow(avg(pow(r - m, 2)), 1.5), 5) AS skew, round(avg(pow(r - m, 4)) / pow(avg(pow(r - m, 2)), 2), 5) AS kurt
    FROM (SELECT *, avg(r) OVER (PARTITION BY trial) AS m FROM ({TRIAL_RETURNS})) GROUP BY 1""")
def moments_sharpe(spark, sf):
    skew, kurt = stats.moments(F.col("r"))
    return frames.trial_returns(spark, sf).groupBy("trial").agg(F.count("*").alias("n"), F.round(stats.sharpe(F.col("r")), 6).alias("sharpe"), F.round(skew, 5).alias("skew"), F.round(kurt, 5).alias("kurt"))


@query(f"""WITH r AS ({TRIAL_RETURNS}), t AS (SELECT t, ntile(8) OVER (ORDER BY t) - 1 AS block FROM (SELECT DISTINCT t FROM r)), m AS (SELECT block, trial, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM r JOIN t USING (t) GROUP BY 1, 2),
    c AS (SELECT m AS mask FROM range(256) g(m) WHERE bit_count(m::INTEGER) = 4),
    z AS (SELECT mask, trial, (mask >> block::INTEGER) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM c, m GROUP BY 1, 2, 3),
    v AS (SELECT mask, trial, inside, round(CASE WHEN (q - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END, 12) AS sr FROM z),
    w AS (SELECT mask, trial, max(sr) FILTER (inside = 1) AS i, max(sr) FILTER (inside = 0) AS o FROM v GROUP BY 1, 2),
    k AS (SELECT mask, rank() OVER (PARTITION BY mask ORDER BY o) + (count(*) OVER (PARTITION BY mask, o) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY mask) AS n, row_number() OVER (PARTITION BY mask ORDER BY i DESC, trial) AS best FROM w)
    SELECT round(avg((rk / (n + 1) <= 0.5)::INTEGER), 6) AS pbo, count(*) AS n_partitions, round(avg(ln(rk / (n + 1) / (1 - rk / (n + 1)))), 6) AS mean_logit FROM k WHERE best = 1""")
def pbo_cscv(spark, sf):
    return rounded(overfit.pbo(frames.trial_returns(spark, sf), 8), ["n_partitions"], ["pbo", "mean_logit"])


@query(f"SELECT asset, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM (SELECT asset, count(*) FILTER (t AND p)::DOUBLE AS tp, count(*) FILTER (NOT t AND NOT p)::DOUBLE AS tn, count(*) FILTER (NOT t AND p)::DOUBLE AS fp, count(*) FILTER (t AND NOT p)::DOUBLE AS fn FROM (SELECT asset, close > 50 AS t, open > 50 AS p FROM ({HOURLY})) GROUP BY 1)")
def matthews(spark, sf):
    b = frames.event_bars(spark, sf).select("asset", (F.col("close") > 50).cast("int").alias("t"), (F.col("open") > 50).cast("int").alias("p"))
    return b.groupBy("asset").agg(F.round(stats.matthews(F.col("t"), F.col("p")), 6).alias("mcc"))


# ---- back-test


@query(f"""SELECT asset, day, CASE WHEN close > {_full('close', 100, 'avg')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sma FROM (SELECT asset, date AS day, close FROM ({ORDER_BARS})) {_windows((100,), order='day')}""")
def sma_signal(spark, sf):
    return frames.order_bars(spark, sf).select("asset", F.col("date").alias("day"), "close").withColumn("sma", backtest.sma_gate(100)).select("asset", "day", "sma")


@query(f"""WITH p AS (SELECT asset, date AS day, close FROM ({ORDER_BARS})), g AS (SELECT asset, day, close, CASE WHEN count(close) OVER g50 = 50 AND close > avg(close) OVER g50 THEN 1 ELSE 0 END AS gate,
        CASE WHEN count(close) OVER b5 = 5 THEN min(close) OVER b5 END AS lo, CASE WHEN count(close) OVER b10 = 10 THEN max(close) OVER b10 END AS hi FROM p
        WINDOW g50 AS (PARTITION BY asset ORDER BY day ROWS 49 PRECEDING), b5 AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), b10 AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, CASE WHEN gate = 0 THEN 0.0 WHEN close <= lo THEN 0.0 WHEN close >= hi THEN 1.0 END AS forced FROM g)
    SELECT asset, day, coalesce(last_value(forced IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS scalar FROM f""")
def donchian_signal(spark, sf):
    p = frames.order_bars(spark, sf).select("asset", F.col("date").alias("day"), "close").withColumn("g", backtest.sma_gate(50))
    return backtest.donchian(p, 10, 5, "g").select("asset", "day", "scalar")


@query(f"""SELECT asset, day, CASE WHEN row_number() OVER u > 365 THEN ret > quantile_cont(ret, 0.8) OVER u ELSE false END AS hv FROM (SELECT asset, date AS day, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r0, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1, 0) AS ret FROM ({ORDER_BARS}))
    WINDOW u AS (PARTITION BY asset ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def expanding_quantile_flags(spark, sf):
    p = frames.order_bars(spark, sf).select("asset", F.col("date").alias("day"), "close")
    p = p.withColumn("vol", F.coalesce(F.col("close") / F.lag("close").over(W.series(["asset"], "day")) - 1, F.lit(0.0)))
    return backtest.high_volatility(p).select("asset", "day", "hv")


HELD = f"SELECT asset, day, ret, (k % 3) * 0.1::DOUBLE AS held, k % 10 = 0 AS hv FROM (SELECT asset, date AS day, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1, 0) * 0.01 AS ret, epoch(date)::BIGINT // 86400 // 3 AS k FROM ({ORDER_BARS}))"


def _held(spark, sf) -> DataFrame:
    p = frames.order_bars(spark, sf).select("asset", F.col("date").alias("day"), "close")
    ret = F.coalesce(F.col("close") / F.lag("close").over(W.series(["asset"], "day")) - 1, F.lit(0.0)) * 0.01
    k = F.expr("cast(unix_date(to_date(day)) div 3 as bigint)")
    return p.select("asset", "day", ret.alias("ret"), ((k % 3) * 0.1).alias("held"), (k % 10 == 0).alias("hv"))


LEDGER = f"""SELECT day, sum(g) AS gross, sum(c) AS cost, sum(held) AS exposure, sum(m) AS turnover, sum(g) - sum(c) AS net FROM (SELECT day, held, coalesce(lag(held) OVER w, 0) * ret AS g, coalesce(lag(cost) OVER w, 0) AS c, coalesce(lag(moved) OVER w, 0) AS m
    FROM (SELECT *, moved * (0.001 + 0.001 * CASE WHEN hv THEN 2 ELSE 1 END) AS cost FROM (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY asset ORDER BY day), 0)) AS moved FROM ({HELD}))) WINDOW w AS (PARTITION BY asset ORDER BY day)) GROUP BY day"""


@query(f"SELECT day, {', '.join(f'round({c}, 8) AS {c}' for c in ('gross', 'cost', 'exposure', 'turnover', 'net'))} FROM ({LEDGER})")
def backtest_ledger(spark, sf):
    return rounded(backtest.ledger(_held(spark, sf)), ["day"], ["gross", "cost", "exposure", "turnover", "net"], 8)


@query(f"""WITH l AS ({LEDGER}), e AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS eq FROM l), d AS (SELECT *, 1 - eq / max(eq) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS dd FROM e)
    SELECT round(avg(net) * 365, 5) AS ann_return, round(stddev_samp(net) * sqrt(365.0::DOUBLE), 5) AS ann_vol, round(avg(net) / stddev_samp(net) * sqrt(365.0::DOUBLE), 5) AS sharpe_ann, round(max(dd), 5) AS max_dd, round(avg(cost) * 365, 5) AS cost_drag_ann,
    round(avg(exposure), 5) AS avg_exposure, count(*) AS t_days FROM d""")
def backtest_metrics(spark, sf):
    return rounded(backtest.metrics(backtest.ledger(_held(spark, sf))), ["t_days"], ["ann_return", "ann_vol", "sharpe_ann", "max_dd", "cost_drag_ann", "avg_exposure"], 5)


@query(f"""SELECT asset, count(*) AS days, round(coalesce(sum(e), 0), 8) AS pnl, trip::BIGINT AS trip FROM (SELECT *, sum(CASE WHEN on_ = b THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY day) AS trip FROM (
    SELECT asset, day, held > 1e-9 AS on_, lag(held > 1e-9) OVER w AS b, held * lead(ret) OVER w AS e FROM ({HELD}) WINDOW w AS (PARTITION BY asset ORDER BY day))) WHERE on_ GROUP BY asset, trip""")
def round_trips(spark, sf):
    return backtest.round_trips(_held(spark, sf)).withColumn("pnl", F.round("pnl", 8))


@query("""WITH r AS (SELECT o_orderdate::DATE AS day, round(avg(o_totalprice) / 100000, 6) AS pct FROM orders WHERE isodow(o_orderdate) <= 5 GROUP BY 1), d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)
    SELECT d.day, round(coalesce(r.pct, 0) / 100, 8) AS rate FROM d ASOF LEFT JOIN r ON (d.day - INTERVAL 2 DAY) >= r.day""")
def cash_rate(spark, sf):
    # no rate is set at weekends
    r = table(spark, sf, "orders").where(F.weekday("o_orderdate") < 5).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("percent"))
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return backtest.cash_rate(d, r).select("day", F.round("rate", 8).alias("rate"))


# ---- text and similarity


#: Every page's URL, and for every document a news URL made of its first nine words, with a year, an id and an ending about them.
NEWS_URLS = r"""SELECT page_id AS id, 'page' AS kind, url FROM pages UNION ALL SELECT doc_id, 'news', 'https://a.example.org/2021/07/' ||
    array_to_string(list_slice(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> ''), 1, 9), '-') || '-' || (100000 + doc_id) || '.html' FROM documents"""


def news_urls(spark, sf) -> DataFrame:
    # a capital I with a dot is one letter to the SQL, two to Spark
    words = F.slice(F.filter(F.split(F.lower(F.translate(F.coalesce("text", F.lit("")), "\u0130", "i")), "[^a-z]+"), lambda x: x != ""), 1, 9)
    made = F.concat(F.lit("https://a.example.org/2021/07/"), F.array_join(words, "-"), F.lit("-"), (F.col("doc_id") + 100000).cast("string"), F.lit(".html"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), "url").unionAll(table(spark, sf, "documents").select("doc_id", F.lit("news"), made))


SLUG = rf"""SELECT id, kind, url, CASE WHEN n >= 3 AND len(string_split(said, ' ')) >= 3 THEN said END AS slug FROM (
    SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(s, '[-_]+', ' ', 'g'), '\b(19|20)\d{{2}}\b', '', 'g'), '\s+', ' ', 'g'))) AS said FROM (
    SELECT id, kind, url, s, len(list_filter(string_split_regex(s, '[-_]+'), lambda t: regexp_matches(t, '[a-zA-Z]{{2,}}'))) AS n,
        row_number() OVER (PARTITION BY id, kind ORDER BY n DESC, place) AS k FROM (
        SELECT id, kind, url, place, regexp_replace(regexp_replace(regexp_replace(seg, '^[-_]+|[-_]+$', '', 'g'), '^((\d{{4,}}|[0-9a-fA-F]{{6,}})([-_]+|$))+', ''), '((^|[-_]+)(\d{{4,}}|[0-9a-fA-F]{{6,}}))+$', '') AS s FROM (
            SELECT id, kind, url, unnest(segs) AS seg, unnest(range(len(segs))) AS place FROM (
                SELECT id, kind, url, list_filter(list_transform(list_filter(string_split(regexp_replace(regexp_extract(url, '^(?:[^:/?#]*://)?[^/?#]*([^?#]*)', 1), '(?i)\.(html?|php|aspx?|shtml|cms|ece|amp)$', ''), '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '^\d+\.', '')),
                    lambda x: NOT regexp_matches(x, '^((19|20)\d{{2}}|\d{{1,2}})$') AND lower(x) NOT IN ({", ".join(f"'{x}'" for x in text.STOP_SEGMENTS)})) AS segs FROM ({NEWS_URLS}))))) WHERE k = 1)"""


@query(f"SELECT u.id, u.kind, slug FROM ({NEWS_URLS}) u LEFT JOIN ({SLUG}) s USING (id, kind)")
def slug_extract(spark, sf):
    return news_urls(spark, sf).select("id", "kind", text.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, parsed[1] AS host, parsed[2] AS path FROM (SELECT page_id, [regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)] AS parsed FROM pages)")
def url_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query("""SELECT a.vec_id AS key, b.vec_id AS ref, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 50 = 0 AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""")
def cosine_matches(spark, sf):
    """Searches with every row whose id is divisible by 50 over all rows."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return dedup.similar_to(e.where("key % 50 = 0"), e, 0.3).withColumn("similarity", F.round("similarity", 5))


@query("""WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
    near AS MATERIALIZED (SELECT a.label, a.i, list(b.i ORDER BY b.i) AS like FROM e a JOIN e b ON a.label = b.label AND b.i < a.i AND list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY 1, 2),
    r AS (SELECT label, 0::BIGINT AS i, []::BIGINT[] AS kept, NULL::BIGINT AS of FROM e GROUP BY label UNION ALL
        SELECT label, i, CASE WHEN of IS NULL THEN list_append(kept, i) ELSE kept END, of FROM (
            SELECT r.label, r.i + 1 AS i, r.kept, list_min(list_intersect(coalesce(n.like, []), r.kept)) AS of FROM r JOIN e ON e.label = r.label AND e.i = r.i + 1 LEFT JOIN near n ON n.label = r.label AND n.i = r.i + 1))
    SELECT r.label, e.vec_id::VARCHAR AS key, o.vec_id::VARCHAR AS duplicate_of FROM r JOIN e ON e.label = r.label AND e.i = r.i LEFT JOIN e o ON o.label = r.label AND o.i = r.of""")
def greedy_duplicates(spark, sf):
    """All vectors as one batch a label, nothing accepted before."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"), F.col("vec_id").alias("seen_at"), "label")
    return dedup.greedy_cosine(e, e.limit(0), 0.35, ["label"])


@query("""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM benchmark)
    SELECT * FROM (SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id) WHERE jaccard >= 0.12""")
def jaccard_pairs(spark, sf):
    t = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("w"))
    return dedup.jaccard_join(t, 0.12).withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT event_id, sha256(event_type || chr(10) || coalesce(props, '')) AS h FROM events")
def content_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", merge.content_hash(F.col("event_type"), F.col("props")).alias("h"))


@query("""SELECT event_id, s AS sentiment FROM (SELECT event_id, event_id % 25 / 10.0::DOUBLE - 1.2::DOUBLE AS s, event_id % 7 AS v FROM events) WHERE round(s, 3) BETWEEN -1 AND 1 AND v BETWEEN 1 AND 5""")
def score_json(spark, sf):
    s = F.round(F.col("event_id") % 25 / F.lit(10.0) - 1.2, 3)
    payload = F.to_json(F.struct(F.array(F.lit("BTC")).alias("assets"), s.alias("sentiment"), F.lit(0.5).alias("confidence"), F.lit("macro").alias("event_type"), (F.col("event_id") % 7).alias("severity"), F.lit(True).alias("is_price_report")))
    return table(spark, sf, "events").select("event_id", readers.scores(payload, news.EVENT_TYPES).alias("x")).where("x is not null").select("event_id", F.col("x.sentiment").alias("sentiment"))


ORACLE["score_json"] = "SELECT event_id, round(event_id % 25 / 10.0::DOUBLE - 1.2::DOUBLE, 3) AS sentiment FROM events WHERE round(event_id % 25 / 10.0::DOUBLE - 1.2::DOUBLE, 3) BETWEEN -1 AND 1 AND event_id % 7 BETWEEN 1 AND 5"


@query("""SELECT c_nationkey::BIGINT AS nation, (DATE '2024-01-05' + k::INTEGER) AS date, c_mktsegment AS fund, round(avg(c_acctbal), 1) AS flow_musd
    FROM customer, (SELECT unnest([0, 1]) AS k) WHERE c_custkey % 2 = k GROUP BY 1, 2, 3""")
def flow_tables(spark, sf):
    """A page for each nation: mean balances by segment, a line for customers of even and one of odd keys; a missing segment is a dash."""
    c = table(spark, sf, "customer").withColumn("k", F.pmod("c_custkey", F.lit(2)).cast("int"))
    segments = [r[0] for r in c.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]  # five
    cells = c.groupBy(F.col("c_nationkey").cast("long").alias("nation"), "k").pivot("c_mktsegment", segments).agg(F.round(F.avg("c_acctbal"), 1))
    said = lambda x: F.when(x.isNull(), "-").when(x < 0, F.concat(F.lit("("), F.format_number(-x, 1), F.lit(")"))).otherwise(F.format_number(x, 1))
    row = F.concat(F.lit("<tr><td>"), F.date_format(F.expr("date_add(date '2024-01-05', k)"), "dd MMM yyyy"), F.lit("</td><td>"), F.concat_ws("</td><td>", *[said(F.col(f"`{s}`")) for s in segments]), F.lit("</td></tr>"))
    pages = cells.groupBy("nation").agg(F.concat_ws("", F.sort_array(F.collect_list(row))).alias("rows"))
    head = "<p>x</p><table><tr><th>Date</th><th>" + "</th><th>".join(segments) + "</th></tr><tr><td>Fee</td><td>1</td></tr>"
    html = F.concat(F.lit(head), "rows", F.lit("<tr><td>Total</td><td>3</td></tr></table><table><tr><td>y</td></tr></table>"))
    return readers.flow_table(pages.select("nation", html.alias("html")), "html", ["nation"]).where("flow_musd is not null")


@query("""SELECT * FROM (VALUES ('o_orderstatus', 'missing', 'string', NULL), ('o_totalprice', 'type', 'double', 'float'), ('more', 'unexpected', NULL, 'int')) t("column", kind, expected, found)""")
def contract_differences(spark, sf):
    blocks = {n: table(spark, sf, n) for n in ("orders", "events")}
    c = contract.build(blocks, "query")
    changed = blocks["orders"].drop("o_orderstatus").withColumn("o_totalprice", F.col("o_totalprice").cast("float")).withColumn("more", F.lit(1))
    return spark.createDataFrame(contract.differences(changed, c, "orders"), "column string, kind string, expected string, found string")


# ---- streams


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS date, event_type, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""")
def stream_daily_bars(spark, sf):
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"stream_daily_bars_{uuid.uuid4().hex}"
    q = flows.run(flows.daily_bars(source), f"{shared_dir(spark)}/{name}", name=name)
    q.awaitTermination()
    return spark.table(name).withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("""SELECT user_id::VARCHAR AS key, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS revision_no, event_type AS content, ts AS at, CASE WHEN before IS NULL THEN 'new' ELSE 'revision' END AS status
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type""")
def stream_revisions(spark, sf):
    """Revisions of a stream of sightings, with state by key, into a table in the shared folder."""
    source = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = flows.revisions(source, "user_id", "event_type", "ts", "event_id")
    to = f"{shared_dir(spark)}/stream_revisions_{uuid.uuid4().hex}"
    flows.run(got, f"{to}/state", path=f"{to}/rows").awaitTermination()
    return spark.read.schema(got.schema).parquet(f"{to}/rows").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(f"SELECT decision_day, count(*) AS n FROM ({_fan('SELECT ts AS usable_at FROM events')}) GROUP BY 1")
def decision_fan_out(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").alias("usable_at"))
    return news.fan_out(e, "usable_at").groupBy("decision_day").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return feature_matrix(spark, sf)


from tideline.plans import queries_backtest, queries_labels, queries_matrix, queries_sources  # noqa: E402, F401
