"""Labels, cross-validation, statistics and back-tests on small, hand-made cases."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import stats
from tideline.operators import labels, regime
from tideline.plans import backtest, cv, gates, overfit, registry

CFG = labels.Barriers(2.0, 2.0, 48)


def flat(spark, n=200, wicks=()):
    rows = [("a", i, 100.0, 100.0, 100.0, 0.01) for i in range(n)]
    for i, high, low in wicks:
        rows[i] = ("a", i, high, low, 100.0, 0.01)
    return spark.createDataFrame(rows, "asset string, idx long, high double, low double, close double, sigma double")


def label(spark, bars, at=50, side=None, cfg=CFG):
    ev = spark.createDataFrame([("a", at)] if side is None else [("a", at, side)], "asset string, idx long" + (", side int" if side else ""))
    got = labels.triple_barrier(ev, bars, cfg).collect()
    return got[0] if got else None


def test_barriers(spark):
    r = label(spark, flat(spark, wicks=[(60, 103.0, 100.0)]))
    assert (r["touch"], r["t1_idx"], r["label"]) == ("up", 60, 1) and abs(r["ret"] - 2 * 0.01 * 2**0.5) < 1e-12
    r = label(spark, flat(spark, wicks=[(55, 100.0, 97.0)]))
    assert (r["touch"], r["label"]) == ("down", -1)
    r = label(spark, flat(spark, wicks=[(52, 103.0, 97.0)]))
    assert (r["touch"], r["label"]) == ("down", -1)
    r = label(spark, flat(spark, wicks=[(50, 103.0, 97.0)]))
    assert (r["touch"], r["label"], r["t1_idx"]) == ("vertical", 0, 98)


def test_barriers_with_sides(spark):
    r = label(spark, flat(spark, wicks=[(60, 103.0, 100.0)]), side=-1)
    assert (r["touch"], r["label"]) == ("up", 0)
    r = label(spark, flat(spark, wicks=[(60, 100.0, 97.0)]), side=-1)
    assert (r["touch"], r["label"]) == ("down", 1)


def test_barriers_drop(spark):
    assert label(spark, flat(spark, 100), at=80) is None
    gap = flat(spark).withColumn("close", F.when(F.col("idx") == 60, float("nan")).otherwise(F.col("close")))
    assert label(spark, gap) is None
    assert label(spark, flat(spark).withColumn("sigma", F.lit(None).cast("double"))) is None


def test_cusum():
    close = 100 * 1.002 ** np.arange(300)
    fired = labels.cusum(close, np.full(300, 0.01))
    assert 45 <= len(fired) <= 60 and min(np.diff(fired)) >= 5
    close[50] = np.nan
    assert len(labels.cusum(close, np.full(300, 0.01))) > 30
    assert labels.cusum(close, np.full(300, np.nan)) == []


def test_weights(spark):
    ev = spark.createDataFrame([("a", 0, 10, 1), ("a", 5, 15, -1)], "asset string, t0_idx long, t1_idx long, label int")
    bars = spark.createDataFrame([("a", i, 100.0 + i % 3) for i in range(30)], "asset string, idx long, close double")
    c = {r["idx"]: r["c"] for r in labels.concurrency(ev, bars).collect()}
    assert (c[0], c[7], c[12], c[16]) == (1, 2, 1, 0)
    w = labels.sample_weights(ev, bars).orderBy("t0_idx").collect()
    assert w[1]["w_decay"] == pytest.approx(1.0) and w[0]["w_decay"] >= 0.75
    assert labels.sample_weights(ev.limit(0), bars).count() == 0


def events(spark, n, hours):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(hours=7 * i), t + dt.timedelta(hours=7 * i + hours[i % len(hours)])) for i in range(n)], "id long, t0 timestamp, t1 timestamp")


@pytest.mark.parametrize("n", [100, 103])
def test_purged_kfold(spark, n):
    ev = events(spark, n, [24, 200, 48])
    at = {r["id"]: (r["t0"], r["t1"]) for r in ev.collect()}
    got = cv.purged_kfold(ev, 5).collect()
    tests = [{r["id"] for r in got if r["split"] == k and r["role"] == "test"} for k in range(5)]
    assert [len(t) for t in tests] == [len(x) for x in np.array_split(np.arange(n), 5)] and set().union(*tests) == set(range(n))
    for k, test in enumerate(tests):
        lo, hi = min(at[i][0] for i in test), max(at[i][1] for i in test)
        want = {i for i in at if i not in test and not (at[i][0] <= hi and at[i][1] >= lo) and not (hi < at[i][0] <= hi + dt.timedelta(days=22))}
        assert want == {r["id"] for r in got if r["split"] == k and r["role"] == "train"}


def test_cpcv(spark):
    got = cv.cpcv(events(spark, 120, [24])).collect()
    assert len({r["split"] for r in got}) == 15 and cv.n_paths() == 5
    m = cv.path_map()
    assert all(len(row) == 5 for row in m)
    combos = list(itertools.combinations(range(6), 2))
    assert all(g in combos[s] for g, row in enumerate(m) for s in row)


def test_sharpe_statistics():
    assert stats.expected_max_sharpe(100, 1.0) == pytest.approx(2.5306028932, abs=1e-3)
    assert stats.psr(0.0, 100) == 0.5
    assert stats.min_track_record(0.1, 0.2, 0, 3) == float("inf")
    n = stats.min_track_record(0.1, 0.0, -0.5, 5.0, 0.95)
    assert stats.psr(0.1, round(n), -0.5, 5.0) == pytest.approx(0.95, abs=1e-3)


def long_form(spark, m):
    return spark.createDataFrame([(t, j, float(m[t, j])) for t in range(m.shape[0]) for j in range(m.shape[1])], "t long, trial int, r double")


def test_pbo(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(0, 0.01, (320, 12))
    good = noise.copy()
    good[:, 3] += 0.006
    assert overfit.pbo(long_form(spark, good), 8).first()["pbo"] < 0.1
    same = np.repeat(noise[:, :1], 6, axis=1)
    assert overfit.pbo(long_form(spark, same), 8).first()["mean_logit"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        overfit.pbo(long_form(spark, same), 7)


def test_pbo_is_brute_force(spark):
    m = np.random.default_rng(2).normal(0, 0.01, (60, 5))
    blocks = np.array_split(np.arange(60), 6)
    logits = []
    for c in itertools.combinations(range(6), 3):
        a, b = np.concatenate([blocks[i] for i in c]), np.concatenate([blocks[i] for i in range(6) if i not in c])
        inside, outside = (m[x].mean(0) / m[x].std(0, ddof=1) for x in (a, b))
        w = (outside < outside[inside.argmax()]).sum() + 1
        logits.append(np.log(w / 6 / (1 - w / 6)))
    got = overfit.pbo(long_form(spark, m), 6).first()
    assert got["mean_logit"] == pytest.approx(np.mean(logits)) and got["pbo"] == pytest.approx(np.mean(np.array(logits) <= 0))


def test_regime_hole(spark):
    d = dt.date
    rows = [(d(2025, 6, 12), 0, 1, 0, 0.5), (d(2025, 6, 13), 0, 1, 0, 0.5), (d(2025, 6, 14), 0, 1, 0, 0.5), (d(2025, 7, 1), -2, 3, 0, 0.5), (d(2025, 7, 2), 0, 3, 0, 0.5)]
    got = {r["decision_day"]: r for r in regime.smoothed(spark.createDataFrame(rows, "date date, risk_appetite int, crypto_stress int, macro_stress int, confidence double")).collect()}
    r = got[d(2025, 7, 2)]
    assert (r["regime_crypto_stress"], r["regime_risk_appetite"], r["regime_ra_delta"], r["regime_gap_days"]) == (3.0, -2.0, None, 17)
    assert got[d(2025, 7, 3)]["regime_ra_delta"] == 2


def test_gates(spark):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=250))
    stress = np.digitize(walk, np.quantile(walk, [0.3, 0.6, 0.9]))
    day = dt.date(2024, 1, 1)
    reg = spark.createDataFrame([(day + dt.timedelta(i), int(1 - stress[i]), int(stress[i]), 0, 0.5) for i in range(250)], "date date, risk_appetite int, crypto_stress int, macro_stress int, confidence double")
    out = spark.createDataFrame([(day + dt.timedelta(i), float(walk[i]), float(walk[i] - walk.min())) for i in range(250)], "date date, fwd_vol_7d double, fwd_maxdd_7d double")
    res = gates.validate(reg, out, n_perm=60)
    assert res["spearman"]["gate"] and res["event_study"]["gate"] and res["persistence"]["gate"] and res["auc"]["auc"] > 0.8
    assert "spearman: PASS" in gates.report(res)
    few = gates.validate(reg.limit(5), out, n_perm=10)
    assert few["spearman"]["gate"] is None and few["summary"]["any_unavailable"]


def test_backtest_earns_the_day_after(spark):
    d = dt.date(2024, 1, 1)
    rows = [("BTC", d + dt.timedelta(i), 0.1 if i == 5 else 0.0, False, 0.30 if i == 4 else 0.0) for i in range(10)]
    df = spark.createDataFrame(rows, "asset string, day date, ret double, hv boolean, held double")
    net = [r["net"] for r in backtest.ledger(df).orderBy("day").collect()]
    assert net[5] == pytest.approx(0.03 - 0.30 * 0.0015) and net[6] == pytest.approx(-0.30 * 0.0015) and net[4] == 0
    late = df.withColumn("held", F.when(F.col("day") == d + dt.timedelta(5), 0.30).otherwise(0.0))
    assert [r["gross"] for r in backtest.ledger(late).orderBy("day").collect()] == [0.0] * 10


def test_sizing(spark):
    df = spark.createDataFrame([("BTC", 1, 1.0, 0.1), ("ETH", 1, 1.0, 0.1), ("BTC", 2, 1.0, 0.4), ("ETH", 2, 0.0, 0.4)], "asset string, day int, scalar double, vol double")
    got = {(r["asset"], r["day"]): r["target"] for r in backtest.target_weights(df).collect()}
    assert got["BTC", 1] == pytest.approx(0.30) and got["BTC", 2] == pytest.approx(0.15) and got["ETH", 2] == 0
    assert backtest.buffered(np.array([0.3, 0.31, 0.34, 0.0, 0.005])).tolist() == [0.3, 0.3, 0.34, 0.0, 0.0]


def test_champion():
    rows = [{"name": n, "config": {}, "dsr": s, "cost_drag_ann": c, "max_dd": 0.1, "sharpe_ann": 1.0, "turnover_ann_oneway": 1.0} for n, s, c in (("a", 0.9, 0.2), ("b", 0.8, 0.05), ("c", 0.7, 0.05))]
    assert backtest.champion(rows, 0.5) == "b" and backtest.champion(rows, 2.0) is None


def test_benchmarks_and_candidates(spark):
    d = dt.date(2024, 1, 1)
    p = spark.createDataFrame([(a, d + dt.timedelta(i), 100.0 + (i * s) % 13) for a, s in (("BTC", 3), ("ETH", 5)) for i in range(90)], "asset string, day date, close double")
    r = backtest.returns(p)
    assert backtest.rebalanced(r, ["BTC", "ETH"]).count() == 90 and backtest.buy_and_hold(r, "BTC").count() == 90
    both = backtest.combined([backtest.signal(r, {"kind": "constant"}), backtest.signal(r, {"kind": "sma", "sma": 5})])
    assert both.agg(F.max("scalar")).first()[0] == 1.0
    assert backtest.metrics(backtest.run(p, backtest.CANDIDATES["S3_EWMAC"])).first()["t_days"] == 90


def test_registry(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "trials"))
    assert reg.count() == 0
    reg.register("p", "m", "24h", {"b": 1, "a": {2, 1}})
    reg.log("p", "m", "24h", {"a": [1, 2], "b": np.int64(1)}, {"x": 1.5})
    reg.register("p", "m2", "24h", {"b": 1})
    assert reg.count() == 2 and reg.count(model="m") == 1 and reg.trials(model="m").count() == 2


def test_purged_model_folds_takes_all_events(spark, sf, monkeypatch):
    from tideline.plans import queries

    monkeypatch.setattr(queries.training, "evaluate", lambda frame, *args, **options: frame)
    frame = queries.purged_model_folds(spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert frame.select("event_id").exceptAll(events.select("event_id")).count() == 0
    assert frame.count() == events.count() > 0


def plain_deviation(close, span_days, min_days, day):
    """The recursion, one return at a time."""
    out, mean, var, seen, a = [], 0.0, 0.0, 0, 2 / (span_days * day + 1)
    for t, c in enumerate(close):
        before = close[t - day] if t >= day else None
        if c is not None and before is not None:
            x = float(np.log(c / before))
            mean, var = (mean + a * (x - mean), (1 - a) * (var + a * (x - mean) ** 2)) if seen else (x, 0.0)
            seen += 1
        out.append(var**0.5 if seen >= min_days * day else None)
    return out


def test_volatility_is_the_recursion(spark):
    r = np.random.default_rng(4)
    paths = {k: (100 * np.exp(np.cumsum(r.normal(0, 0.01, 700)))).tolist() for k in ("a", "b")}
    paths["b"][40] = paths["b"][300] = None
    rows = [(k, i, c, c, c) for k, p in paths.items() for i, c in enumerate(p)]
    df = spark.createDataFrame(rows, "asset string, idx long, high double, low double, close double")
    got = {(x["asset"], x["idx"]): x["sigma"] for x in labels.with_volatility(df, span_days=3, min_days=2, day=6).collect()}
    for k, p in paths.items():
        for i, want in enumerate(plain_deviation(p, 3, 2, 6)):
            assert got[k, i] == (None if want is None else pytest.approx(want, rel=1e-9)), (k, i)


def plain_cusum(close, h):
    out, up, down = [], 0.0, 0.0
    for t in range(1, len(close)):
        r = np.log(close[t] / close[t - 1])
        if np.isnan(r):
            up = down = 0.0
            continue
        up, down = max(0.0, up + r), min(0.0, down + r)
        if up >= h[t]:
            out.append(t)
            up = 0.0
        elif down <= -h[t]:
            out.append(t)
            down = 0.0
    return out


def test_cusum_is_the_recursion():
    for seed in range(30):
        r = np.random.default_rng(seed)
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 3000)))
        close[r.random(3000) < 0.01 * (seed % 2)] = np.nan
        h = np.where(r.random(3000) < 0.05, np.nan, r.uniform(0.005, 0.06, 3000))
        assert labels.cusum(close, h) == plain_cusum(close, h)


def test_rebalanced_is_the_day_by_day_account(spark):
    r = np.random.default_rng(9)
    first = dt.date(2023, 11, 30)
    days = [first + dt.timedelta(i) for i in range(100)]
    ret = {"BTC": r.normal(0, 0.03, 100), "ETH": r.normal(0, 0.05, 100)}
    ret["ETH"][50] = np.nan
    rows = [(a, d, float(x)) for a, xs in ret.items() for d, x in zip(days, xs, strict=True) if x == x]
    df = spark.createDataFrame(rows, "asset string, day date, ret double")
    for start in (first, dt.date(2023, 12, 1), dt.date(2023, 12, 20)):
        got = {x["day"]: x["net"] for x in backtest.rebalanced(df, ["BTC", "ETH"], score_from=start).collect()}
        weights, side, want = np.array([0.5, 0.5]), 0.001 + 0.00075, {}
        for i, d in enumerate(days):
            if d < start:
                continue
            worth = weights * (1 + np.nan_to_num(np.array([ret["BTC"][i], ret["ETH"][i]])))
            want[d] = worth.sum() - 1 - (side if not want else 0)
            weights = worth / worth.sum()
            if d.day == 1:
                want[d] -= np.abs(weights - 0.5).sum() * side
                weights = np.array([0.5, 0.5])
        assert got == pytest.approx(want)


def test_canonical():
    from tideline.plans.registry import canonical

    assert canonical({2: (1, np.float64(1.5)), "a": {3, 1}, True: [np.int64(4), None]}) == {"2": [1, 1.5], "True": [4, None], "a": [1, 3]}
    assert list(canonical({"b": 1, "a": 2})) == ["a", "b"]
