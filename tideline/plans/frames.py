"""Inputs of the registered queries: the library's tables as read from the driver's ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of event values by event type: (asset, open_time, open, high, low, close, volume, quote_volume, trades, taker_buy_base)."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("asset"), F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("open_time")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.sum("value").alias("quote_volume"), F.count("*").alias("trades"), F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value")).otherwise(0.0)).alias("taker_buy_base"),
    )


EVENT_BARS = """SELECT event_type AS asset, date_trunc('{unit}', ts)::TIMESTAMP AS open_time,
    arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    sum(value) AS volume, sum(value) AS quote_volume, count(*) AS trades, sum(CASE WHEN user_id % 2 = 0 THEN value ELSE 0 END) AS taker_buy_base
    FROM events GROUP BY 1, 2"""


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices by priority: (asset, date, open, high, low, close, volume, quote_volume, trades, taker_buy_base)."""
    o = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("asset"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("date")).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"),
        F.sum(p).alias("volume"), F.sum(p).alias("quote_volume"), F.count("*").alias("trades"), F.sum(F.when(F.col("o_orderstatus") == "F", p).otherwise(0.0)).alias("taker_buy_base"),
    )


ORDER_BARS = """SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS date,
    arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, sum(o_totalprice) AS volume, sum(o_totalprice) AS quote_volume,
    count(*) AS trades, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS taker_buy_base FROM orders GROUP BY 1, 2"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored article revisions: a user is an article, its events are revisions."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("url_hash"), n.cast("int").alias("revision_no"),
        F.when(n % 9 != 0, F.col("ts")).alias("published_at_utc"), (F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 7 as int), 0, 0)")).alias("first_seen_at_utc"), (n % 4 == 0).alias("backfilled"),
        (F.col("ts") + F.expr("make_dt_interval(0, cast(event_id % 200 as int), 0, 0)")).alias("scored_at_utc"), F.when(n % 11 == 0, "failed").otherwise("m1").alias("model"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 3 == 0, "BTC,ETH").when(n % 3 == 1, "BTC").otherwise("ETH").alias("assets"),
        (n % 21 / F.lit(10.0) - 1.0).alias("sentiment"), F.when(n % 6 != 0, n % 10 / F.lit(10.0)).alias("confidence"),
        F.element_at(F.array(*[F.lit(x) for x in ("etf_flow", "regulation", "hack_exploit", "macro", "other")]), (n % 5 + 1).cast("int")).alias("event_type"),
        (n % 5 + 1).cast("int").alias("severity"), (n % 8 == 0).alias("is_price_report"), F.when(n % 5 == 0, "x").alias("duplicate_of"),
    )


ARTICLES = """SELECT user_id::VARCHAR AS url_hash, event_id::INTEGER AS revision_no, CASE WHEN event_id % 9 <> 0 THEN ts END AS published_at_utc,
    ts + (event_id % 7) * INTERVAL 1 HOUR AS first_seen_at_utc, event_id % 4 = 0 AS backfilled, ts + (event_id % 200) * INTERVAL 1 HOUR AS scored_at_utc,
    CASE WHEN event_id % 11 = 0 THEN 'failed' ELSE 'm1' END AS model,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'BTC,ETH' WHEN event_id % 3 = 1 THEN 'BTC' ELSE 'ETH' END AS assets,
    event_id % 21 / 10.0::DOUBLE - 1.0::DOUBLE AS sentiment, CASE WHEN event_id % 6 <> 0 THEN event_id % 10 / 10.0::DOUBLE END AS confidence,
    (['etf_flow', 'regulation', 'hack_exploit', 'macro', 'other'])[(event_id % 5 + 1)::INTEGER] AS event_type, (event_id % 5 + 1)::INTEGER AS severity,
    event_id % 8 = 0 AS is_price_report, CASE WHEN event_id % 5 = 0 THEN 'x' END AS duplicate_of FROM events"""

#: A clocked view of ARTICLES: pit_usable_at and usable_at.
CLOCKED = f"""SELECT *, greatest(pit_usable_at, scored_at_utc + INTERVAL 5 MINUTE) AS usable_at FROM (
    SELECT *, CASE WHEN backfilled AND published_at_utc IS NOT NULL THEN published_at_utc + INTERVAL 4 HOUR
        ELSE greatest(first_seen_at_utc, coalesce(published_at_utc, first_seen_at_utc)) + INTERVAL 30 MINUTE END AS pit_usable_at FROM ({ARTICLES}))"""


def tone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    themes = F.when(n % 4 == 0, "ECON_INFLATION;TAX_FNCACT").when(n % 4 == 1, "CYBER_ATTACK;EPU_POLICY").when(n % 4 == 2, "BANKRUPTCY")
    return e.select(F.col("ts").alias("file_time"), ((n % 41 - 20) / F.lit(4.0)).alias("tone"), (n % 13 / F.lit(2.0)).alias("positive"), (n % 17 / F.lit(2.0)).alias("negative"), (n % 30).cast("int").alias("n_themes"), themes.alias("themes"))


TONE_ROWS = """SELECT ts AS file_time, (event_id % 41 - 20) / 4.0::DOUBLE AS tone, event_id % 13 / 2.0::DOUBLE AS positive, event_id % 17 / 2.0::DOUBLE AS negative,
    (event_id % 30)::INTEGER AS n_themes, CASE event_id % 4 WHEN 0 THEN 'ECON_INFLATION;TAX_FNCACT' WHEN 1 THEN 'CYBER_ATTACK;EPU_POLICY' WHEN 2 THEN 'BANKRUPTCY' END AS themes FROM events"""


def regime_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily regime series from orders by day; a day without an urgent order has no regime, which makes holes in small tables."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("k"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return o.where("urgent > 0").select("date", (F.col("k") % 5 - 2).cast("int").alias("risk_appetite"), (F.col("n") % 4).cast("int").alias("crypto_stress"), (F.col("k") % 4).cast("int").alias("macro_stress"), (F.col("k") % 10 / F.lit(10.0)).alias("confidence"))


REGIME_DAYS = """SELECT date, (k % 5 - 2)::INTEGER AS risk_appetite, (n % 4)::INTEGER AS crypto_stress, (k % 4)::INTEGER AS macro_stress, k % 10 / 10.0::DOUBLE AS confidence
    FROM (SELECT o_orderdate::DATE AS date, count(*) AS n, sum(o_orderkey)::BIGINT AS k FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority = '1-URGENT') > 0)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled events: id, t0 (order date) and t1 (last shipment)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ship = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("t1"))
    return o.join(ship, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t0"), F.greatest("t1", "o_orderdate").alias("t1"))


INTERVALS = """SELECT o_orderkey AS id, o_orderdate AS t0, greatest(max(l_shipdate), o_orderdate) AS t1 FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY o_orderkey, o_orderdate"""


def trial_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily returns of seven trials (t, trial, r), from line items by ship day and line number."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.to_date("l_shipdate").alias("t"), F.col("l_linenumber").alias("trial")).agg(F.round(F.avg(F.col("l_discount") - 0.05), 9).alias("r"))


TRIAL_RETURNS = "SELECT l_shipdate::DATE AS t, l_linenumber AS trial, round(avg(l_discount - 0.05::DOUBLE), 9) AS r FROM lineitem GROUP BY 1, 2"
