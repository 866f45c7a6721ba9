"""Registered query of the whole feature matrix: price, derivatives, implied volatility, published sources, and news of both eras, a row a key and decision day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import bars, matrix, news
from tideline.plans import frames
from tideline.plans.frames import ORDER_BARS, table
from tideline.plans.queries import NUMBERED, ORACLE, U, _full, _vol, _windows, _z, query

#: Line items by the priority of their order: what is paid for and reported for an asset.
ITEMS = """SELECT o_orderpriority AS asset, l_shipdate AS t, l_orderkey * 10 + l_linenumber AS k, l_discount - 0.05::DOUBLE AS rate, l_quantity, l_extendedprice, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
PRICE = ("ret_1d", "bb_pctb", "px_vs_ma200", "taker_imbalance_5d")
FUNDING, POSITIONS, IMPLIED = ("funding_1d", "funding_z_30d", "funding_7d_cum"), ("oi", "oi_chg_1d", "top_ls_pos_ratio"), ("iv_30d", "iv_chg_5d", "iv_intraday_range")


def items(spark, sf) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("asset"), F.col("l_shipdate").alias("t"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_discount") - 0.05).alias("rate"), "l_quantity", "l_extendedprice", "l_tax")


def _published(name: str, source: str, value: str, cap: int, by: bool = True) -> tuple[str, str, str]:
    """Columns, join and CTE of a source joined as of its publication."""
    age = f"date_diff('minute', {name}.published_at, s.decision_day) / 60.0::DOUBLE"
    columns = f"{age} AS {name}_age_h, round(CASE WHEN coalesce({age} <= {cap}, true) THEN {name}.v END, 6) AS {name}_{value}"
    return columns, f"ASOF LEFT JOIN {name} ON {f'{name}.asset = s.asset AND ' if by else ''}s.decision_day >= {name}.published_at", f"{name} AS ({source})"


SOURCES = [
    _published("oc", f"SELECT asset, date + INTERVAL 1 DAY + INTERVAL 6 HOUR AS published_at, volume AS v FROM ({ORDER_BARS}) WHERE isodow(date) <= 5", "tx", 48),
    _published("macro_f", "SELECT o_orderdate::DATE + INTERVAL 1 DAY + INTERVAL 13 HOUR AS published_at, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", "value", 240, by=False),
    _published("macro_o", "SELECT o_orderdate::DATE + INTERVAL 1 DAY + INTERVAL 13 HOUR AS published_at, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1", "value", 240, by=False),
    _published("stable_total", "SELECT l_shipdate::DATE + INTERVAL 25 HOUR AS published_at, sum(l_quantity) AS v FROM lineitem GROUP BY 1", "value", 48, by=False),
    _published("etf", f"SELECT asset, t::DATE + INTERVAL 45 HOUR AS published_at, round(sum(l_extendedprice), 4) AS v FROM ({ITEMS}) GROUP BY 1, 2", "flow_total_musd", 120),
    _published("fng", "SELECT o_orderdate::DATE + INTERVAL 1 HOUR AS published_at, (count(*) % 100)::DOUBLE AS v FROM orders GROUP BY 1", "fng_value", 72, by=False),
]
ERAS = """SELECT asset, day, n, era FROM (SELECT *, row_number() OVER (PARTITION BY asset, day ORDER BY era) AS r FROM (
    SELECT o_orderpriority AS asset, o_orderdate::DATE AS day, count(*) AS n, 0 AS era FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2 UNION ALL SELECT o_orderpriority, o_orderdate::DATE, count(*), 1 FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)) WHERE r = 1"""
ATTENTION = f"""SELECT asset, day::TIMESTAMP AS decision_day, n AS news_count_24h, era AS era_llm, round(ln(1 + n) - ln(1 + CASE WHEN count(b) OVER w8 = 8 THEN quantile_cont(b, 0.5) OVER w8 END), 6) AS news_attn_abnormal,
    n < CASE WHEN count(b) OVER w8 = 8 THEN list_sort(list(b) OVER w8)[2] END AS low_news_flag FROM (SELECT *, dayofweek(day) AS dow, lag(n::DOUBLE) OVER (PARTITION BY asset, dayofweek(day) ORDER BY day) AS b FROM (
        SELECT c.asset, c.day, coalesce(n, 0)::BIGINT AS n, era FROM (SELECT asset, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM ({ERAS}) GROUP BY asset) c LEFT JOIN ({ERAS}) d ON c.asset = d.asset AND c.day = d.day))
    WINDOW w8 AS (PARTITION BY asset, dow ORDER BY day ROWS 7 PRECEDING)"""


@query(f"""WITH p AS ({ORACLE["price_block"]}), v AS (SELECT asset, date, close / 100 AS iv, {_vol[21]} AS vol FROM ({NUMBERED}) {U}),
    fu AS (SELECT asset, date, round(f, 6) AS funding_1d, {_z("f", 30, "funding_z_30d")}, round({_full("f", 7, "sum")}, 6) AS funding_7d_cum FROM (SELECT asset, date_trunc('day', t)::TIMESTAMP AS date, sum(rate) AS f FROM ({ITEMS}) GROUP BY 1, 2) {_windows((7, 30))}),
    po AS (SELECT asset, date, round(oi, 4) AS oi, round(oi_usd / nullif(lag(oi_usd, 1) OVER w, 0) - 1, 6) AS oi_chg_1d, round(top, 6) AS top_ls_pos_ratio FROM (
        SELECT asset, date_trunc('day', t)::TIMESTAMP AS date, arg_max(l_quantity, (t, k, l_quantity, l_extendedprice)) AS oi, arg_max(l_extendedprice, (t, k, l_quantity, l_extendedprice)) AS oi_usd, avg(l_tax) AS top FROM ({ITEMS}) GROUP BY 1, 2) {_windows((90,))}),
    iv AS ({ORACLE["implied_volatility_block"]}), nw AS ({ATTENTION}), {", ".join(x[2] for x in SOURCES)},
    s AS (SELECT asset, date, date + INTERVAL 1 DAY AS decision_day, {", ".join(f"p.{c}" for c in PRICE)}, round(v.iv / sqrt(365.0::DOUBLE) - v.vol, 6) AS vrp_daily FROM p JOIN v USING (asset, date))
    SELECT s.asset, s.decision_day, {", ".join(f"s.{c}" for c in PRICE)}, {", ".join(f"fu.{c}" for c in FUNDING)}, {", ".join(f"po.{c}" for c in POSITIONS)}, po.asset IS NULL AS positioning_missing, {", ".join(f"iv.{c}" for c in IMPLIED)},
    s.vrp_daily, {", ".join(x[0] for x in SOURCES)}, nw.news_count_24h, nw.era_llm, nw.news_attn_abnormal, nw.low_news_flag
    FROM s LEFT JOIN fu ON fu.asset = s.asset AND fu.date = s.date LEFT JOIN po ON po.asset = s.asset AND po.date = s.date LEFT JOIN iv ON iv.asset = s.asset AND iv.date = s.date
    LEFT JOIN nw ON nw.asset = s.asset AND nw.decision_day = s.decision_day {" ".join(x[1] for x in SOURCES)}""")
def whole_matrix(spark, sf):
    daily, li, o = frames.order_bars(spark, sf), items(spark, sf), table(spark, sf, "orders")
    blocks = {
        "funding": bars.funding_daily(li.select("asset", F.col("t").alias("funding_time"), "k", F.col("rate").alias("funding_rate")), tie="k").select("asset", "date", *FUNDING),
        "positioning": bars.metrics_daily(li.select("asset", F.col("t").alias("create_time"), F.struct("k", "l_quantity", "l_extendedprice").alias("k"), F.col("l_quantity").alias("sum_open_interest"), F.col("l_extendedprice").alias("sum_open_interest_value"), *[F.col("l_tax").alias(c) for c in bars.POSITIONING.values()]), tie="k").select("asset", "date", *POSITIONS, "positioning_missing"),
        "iv": bars.dvol_daily(daily.select("asset", F.col("date").alias("time"), *[F.col(c).alias(f"dvol_{c}") for c in ("open", "high", "low", "close")])).select("asset", "date", *IMPLIED),
    }
    at = lambda day, hours: (F.col(day).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, {hours})"))
    o = o.withColumn("day", F.to_date("o_orderdate"))
    li = li.withColumn("day", F.to_date("t"))
    macro = o.where("o_orderstatus <> 'P'").groupBy(F.lower("o_orderstatus").alias("series"), "day").agg(F.avg("o_totalprice").alias("value")).select("series", "value", at("day", 37).alias("published_at"))
    chain = daily.where(F.weekday("date") < 5).select("asset", at("date", 30).alias("published_at"), F.col("volume").alias("tx"))
    stable = li.groupBy("day").agg(F.sum("l_quantity").alias("value")).select("value", at("day", 25).alias("published_at"))
    etf = li.groupBy("asset", "day").agg(F.round(F.sum("l_extendedprice"), 4).alias("flow_total_musd")).select("asset", "flow_total_musd", at("day", 45).alias("published_at"))
    fng = o.groupBy("day").agg((F.count("*") % 100).cast("double").alias("fng_value")).select("fng_value", at("day", 1).alias("published_at"))
    published = [
        matrix.Published(chain, ["tx"], "oc", matrix.CAPS["onchain"]), *matrix.macro_blocks(macro, ["f", "o"]), matrix.Published(stable, ["value"], "stable_total", matrix.CAPS["stablecoins"], ()),
        matrix.Published(etf, ["flow_total_musd"], "etf", matrix.CAPS["etf"]), matrix.Published(fng, ["fng_value"], "fng", matrix.CAPS["fng"], ()),
    ]
    era = lambda c, n: o.where(c).groupBy(F.col("day").alias("decision_day"), F.col("o_orderpriority").alias("asset")).agg(F.count("*").alias("news_count_24h")).withColumn("era_llm", F.lit(n))
    both = news.abnormal_attention(news.cut_over(era("o_orderstatus = 'F'", 0), era("o_orderstatus <> 'F'", 1), ["asset"]), by=["asset"])
    both = both.withColumn("decision_day", F.col("decision_day").cast("timestamp_ntz"))
    out = matrix.assemble(bars.price_features(daily), blocks, published, both)
    matrix.check_unique(out)
    values = [*PRICE, *FUNDING, *POSITIONS, *IMPLIED, "oc_tx", "macro_f_value", "macro_o_value", "stable_total_value", "etf_flow_total_musd", "fng_fng_value", "news_attn_abnormal"]
    digits = {"funding_z_30d": 5, "oi": 4}
    ages = [f"{p.prefix}_age_h" for p in published]
    return out.select("asset", "decision_day", *[F.round(c, digits.get(c, 6)).alias(c) for c in [*values, "vrp_daily"]], "positioning_missing", *ages, "news_count_24h", "era_llm", "low_news_flag")
