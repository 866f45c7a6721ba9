"""Publication clocks, as-of joins, and that nothing later changes what was known before."""

import datetime as dt

from pyspark.sql import functions as F

from tideline.functions import clock
from tideline.operators import asof, news
from tideline.operators import windows as W

D = dt.datetime(2026, 7, 2)
H = dt.timedelta(hours=1)


def test_asof_published_next_day_only(spark):
    spine = spark.createDataFrame([(D + i * 24 * H,) for i in range(4)], "decision_day timestamp")
    src = spark.createDataFrame([(D + H, 42.0)], "published_at timestamp, value double")
    got = [r["x_value"] for r in asof.asof_published(spine, src, ["value"], "x", 48).orderBy("decision_day").collect()]
    assert got == [None, 42.0, 42.0, None]


def test_asof_stale_keeps_age(spark):
    spine = spark.createDataFrame([(D,)], "decision_day timestamp")
    src = spark.createDataFrame([(D - 240 * H, 7.0)], "published_at timestamp, value double")
    r = asof.asof_published(spine, src, ["value"], "x", 48).first()
    assert r["x_value"] is None and r["x_age_h"] == 240.0


def test_asof_newest_row_with_null_wins_and_null_times_match_nothing(spark):
    left = spark.createDataFrame([("a", D), ("a", None), (None, D)], "k string, t timestamp")
    right = spark.createDataFrame([("a", D - 2 * H, 1.0), ("a", D - H, None), ("a", None, 9.0), (None, D - H, 5.0)], "k string, p timestamp, v double")
    for bucket in (None, 3600):
        got = {(r["k"], r["t"]): r["matched"] and (r["matched"]["p"], r["matched"]["v"]) for r in asof.asof_backward(left, right, "t", "p", ["k"], bucket).collect()}
        assert got == {("a", D): (D - H, None), ("a", None): None, (None, D): (D - H, 5.0)}


def test_usable_at(spark):
    rows = [(D - 31 * H / 60, D - 40 * H / 60, False), (D + H, D, False), (None, D, False), (D, D + 5000 * H, True), (None, D, True)]
    df = spark.createDataFrame(rows, "p timestamp, s timestamp, b boolean")
    got = [r[0] for r in df.select(clock.usable_at(F.col("p"), F.col("s"), F.col("b"))).collect()]
    half = H / 2
    assert got == [D - 31 * H / 60 + half, D + H + half, D + half, D + 4 * H, D + half]


def test_usable_window_edges(spark):
    s = dt.timedelta(seconds=1)
    df = spark.createDataFrame([(D,), (D + s,), (D - 24 * H,), (D - 24 * H + s,)], "u timestamp")
    assert [r[0] for r in df.select(clock.is_usable(F.col("u"), F.lit(D))).collect()] == [True, False, False, True]


def test_release_clock(spark):
    # Friday to Monday; over an observed holiday; summer and winter time
    rows = [(dt.date(2025, 3, 7), 1, "16:15"), (dt.date(2026, 7, 2), 1, "16:15"), (dt.date(2025, 1, 6), 0, "18:00"), (dt.date(2025, 7, 7), 0, "18:00")]
    df = spark.createDataFrame(rows, "d date, n int, at string")
    got = {r["d"]: r["published_at"] for r in clock.released_at(df, "d", F.col("n"), F.col("at")).collect()}
    assert got[dt.date(2025, 3, 7)] == dt.datetime(2025, 3, 10, 20, 15)
    assert got[dt.date(2026, 7, 2)] == dt.datetime(2026, 7, 6, 20, 15)
    assert got[dt.date(2025, 1, 6)] == dt.datetime(2025, 1, 6, 23, 0)
    assert got[dt.date(2025, 7, 7)] == dt.datetime(2025, 7, 7, 22, 0)


def test_epochs(spark):
    df = spark.createDataFrame([(1577836800.0,), (1577836800000.0,), (1577836800000000.0,)], "x double")
    assert {r[0] for r in df.select(clock.from_epoch(F.col("x"))).collect()} == {dt.datetime(2020, 1, 1)}


def test_fan_out_excludes_its_own_midnight(spark):
    df = spark.createDataFrame([(D - 3 * H,), (D,)], "u timestamp")
    first = [r[0] for r in news.fan_out(df, "u").groupBy("u").agg(F.min("decision_day")).orderBy("u").select("min(decision_day)").collect()]
    assert first == [D, D + 24 * H]
    assert news.fan_out(df, "u").where("age_h <= 0").count() == 0


def test_decay(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-1.0, 100.0)], "s double, age_h double")
    got = df.agg(news.decayed(F.col("s"), F.lit(1.0), 24.0)).first()[0]
    assert abs(got - 0.8916) < 1e-3


def test_full_windows_and_tampering(spark):
    rows = [("a", i, float(i * i % 7) + 1) for i in range(60)] + [("b", 0, 5.0)]
    w = W.series(["k"], "i")
    f = lambda r: {(x["k"], x["i"]): tuple(x)[3:] for x in W.ewm(spark.createDataFrame(r, "k string, i int, x double"), {"e": (F.col("x"), 0.2)}, ["k"], "i").withColumns({"m": W.rolling_mean(F.col("x"), 5, w), "z": W.zscore(F.col("x"), 5, w)}).collect()}
    one, two = f(rows), f([*rows[:59], ("a", 59, 1000.0), rows[60]])
    assert all(one[k] == two[k] for k in one if k != ("a", 59)) and one["a", 59] != two["a", 59]
    assert one["a", 3][1] is None and one["a", 4][1] is not None and one["b", 0][1] is None


def test_ewm_is_the_recursion_over_chunks(spark):
    x = [((i * 37) % 101) / 10 if i % 17 else None for i in range(3000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, i int, x double")
    got = [r["e"] for r in W.ewm(df, {"e": (F.col("x"), 0.3)}, ["k"], "i").orderBy("i").collect()]
    num = den = 0.0
    for v, g in zip(x, got, strict=True):
        num, den = num * 0.7, den * 0.7
        if v is None:
            assert g is None
            continue
        num, den = num + v, den + 1
        assert abs(g - num / den) < 1e-10


def test_attention(spark):
    start = dt.date(2026, 1, 5)
    days = [(start + dt.timedelta(i), 15 if (start + dt.timedelta(i)).weekday() == 0 else 10) for i in range(70)]
    got = news.abnormal_attention(spark.createDataFrame(days, "decision_day date, news_count_24h long")).orderBy("decision_day").collect()
    assert all(abs(r["news_attn_abnormal"]) < 0.05 for r in got[-10:]) and got[0]["news_attn_abnormal"] is None
