"""The store, the switch and jobs over a small data folder."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import jobs
from tideline.operators import matrix
from tideline.plans.store import Store
from tideline.plans.switch import Disabled, Switch
from tideline.sources import readers

T = dt.datetime(2024, 1, 1)


def sightings(spark, rows):
    return spark.createDataFrame([("s", 1, u, t, b, T, seen, False) for u, t, b, seen in rows], "source string, tier int, url string, title string, body string, published_at_utc timestamp_ntz, first_seen_at_utc timestamp_ntz, backfilled boolean")


def test_switch(tmp_path, monkeypatch):
    monkeypatch.delenv("TIDELINE_MODELS", raising=False)
    s = Switch(str(tmp_path / "x" / "flag"))
    now = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert not s.enabled()
    with pytest.raises(Disabled):
        s.ensure("x")
    s.on(2, now)
    assert s.enabled(now + dt.timedelta(hours=1)) and not s.enabled(now + dt.timedelta(hours=2))
    (tmp_path / "x" / "flag").write_text("{")
    assert not s.enabled(now) and s.until() is None
    for bad in (0, 200):
        with pytest.raises(ValueError):
            s.on(bad)
    s.off()
    monkeypatch.setenv("TIDELINE_MODELS", "1")
    assert s.enabled()


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDELINE_MODELS", "1")
    store, h = Store(spark, str(tmp_path)), dt.timedelta(hours=1)
    assert store.upsert(sightings(spark, [("u1", "a", "x", T), ("u2", "b", "y", T)])) == {"new": 2, "revision": 0, "unchanged": 0}
    assert store.upsert(sightings(spark, [("u1", "a", "x", T + h), ("u2", "b", "z", T + h), ("u3", "fail", "q", T + h)])) == {"new": 1, "revision": 1, "unchanged": 1}
    assert store.table("articles").where("revision_no = 0 and title = 'b'").first()["body"] == "y"

    def scorer(title, body):
        if title == "fail":
            raise OSError("no service")
        return json.dumps({"assets": ["BTC"], "sentiment": 0.5, "confidence": 0.5, "event_type": "macro", "severity": 2, "is_price_report": False})

    def embedder(texts):
        return [[1.0, 0.0] if t.startswith("b") else [0.0, 1.0] if t.startswith("a") else [1.0, -1.0] for t in texts]

    switch = Switch(str(tmp_path / "flag"))
    assert store.score_pending(scorer, embedder, switch) == {"scored": 2, "duplicates": 1, "failed": 1}
    assert store.score_pending(scorer, embedder, switch) == {"scored": 0, "duplicates": 0, "failed": 0}
    feeds = spark.createDataFrame([("f", 1, None, "boom", None, None, T + i * h) for i in range(3)] + [("g", 2, "<item><link>u9</link><title>t</title></item>", None, "e", "m", T)], "feed_name string, tier int, xml string, error string, etag string, modified string, first_seen_at_utc timestamp")
    assert store.collect(feeds)["new"] == 1
    s = store.stats()
    assert s["articles_total"] == 4 and s["unhealthy_feeds"][0][:2] == ("f", 3) and s["last_run"]["feeds_failed"] == 3


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    r = np.random.default_rng(1)
    rows = []
    for asset in ("BTC", "ETH"):
        p = 100 * np.exp(np.cumsum(r.normal(0, 0.01, 24 * 60)))
        rows += [(asset, T + dt.timedelta(hours=i), float(p[i - 1] if i else p[i]), float(p[i] * 1.01), float(p[i] * 0.99), float(p[i]), 10.0 + i % 7, 1000.0, 5, 4.0, 400.0) for i in range(len(p))]
    k = spark.createDataFrame(rows, "asset string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double, taker_buy_quote double")
    k.write.parquet(str(root / "raw" / "klines"))
    spark.createDataFrame([(a, T + dt.timedelta(hours=8 * i), 0.0001 * (i % 5)) for a in ("BTC", "ETH") for i in range(180)], "asset string, funding_time timestamp_ntz, funding_rate double").write.parquet(str(root / "raw" / "funding"))
    spark.createDataFrame([("S1", T + dt.timedelta(days=7 * i, hours=20), float(i)) for i in range(8)], "series string, published_at timestamp_ntz, value double").write.parquet(str(root / "raw" / "macro"))
    spark.createDataFrame([(T + dt.timedelta(hours=3 * i), "BTC,ETH" if i % 2 else "BTC", float(i % 9 - 4), 1.0, 2.0, i % 6, "TAX_X") for i in range(400)], "file_time timestamp_ntz, assets string, tone double, positive double, negative double, n_themes int, themes string").write.parquet(str(root / "raw" / "gkg"))
    return jobs.Lake(spark, str(root))


def test_matrix_job_and_tampering(spark, lake):
    one = jobs.build_matrix(lake)
    assert one.count() == 120 and {"funding_1d", "macro_s1_value", "macro_s1_age_h", "news_sent_h1d", "news_attn_abnormal", "rsi_14"} <= set(one.columns)
    late = T + dt.timedelta(days=59)
    changed = lake.raw("klines").withColumn("close", F.when(F.col("open_time") >= F.lit(late), F.col("close") * 3).otherwise(F.col("close"))).cache()
    daily = [jobs.bars.price_features(jobs.bars.to_daily(k)) for k in (lake.raw("klines"), changed)]
    known = [matrix.assemble(d).where(F.col("decision_day") <= F.lit(late)).select("asset", "decision_day", "ret_1d", "rsi_7", "vol_ewma_21d", "bb_pctb") for d in daily]
    assert known[0].exceptAll(known[1]).count() == 0 == known[1].exceptAll(known[0]).count()
    with pytest.raises(ValueError):
        matrix.check_unique(one.unionAll(one.limit(1)))
    cover = {(r["asset"], r["block"]): r["null_share"] for r in matrix.coverage(one, {"funding": "funding_", "iv": "iv_"}).collect()}
    assert cover["BTC", "funding"] < 0.1 and ("BTC", "iv") not in cover


def test_label_and_status_jobs(spark, lake, monkeypatch):
    monkeypatch.setattr(jobs, "HORIZONS", {"24h": 24})
    got = {r["asset"]: r for r in jobs.generate_labels(lake)["24h"].collect()}
    assert got["BTC"]["events"] > 5 and got["BTC"]["up"] + got["BTC"]["down"] + got["BTC"]["flat"] == got["BTC"]["events"]
    made = spark.read.parquet(lake.path("labels", "24h"))
    assert made.where("t1_time <= t0_time or sample_weight <= 0").count() == 0
    variants = jobs.labels.generate_variants(lake.raw("klines").select("asset", "open_time", "high", "low", "close"), made, [2.0], jobs.labels.Barriers(horizon=24))
    assert variants["_m20"].select("asset", "t0_time").exceptAll(made.select("asset", "t0_time")).count() == 0
    s = jobs.status(lake)
    assert s["rows"]["klines"] == 2880 and s["trials"] == 0
    fresh = {r["feed"]: r["fresh"] for r in jobs.freshness(lake, T + dt.timedelta(days=61)).collect()}
    assert fresh["klines"] is True
    assert jobs.main(["models-on", "--root", lake.root, "--hours", "1"]) == 0 and lake.switch().enabled() and jobs.main(["models-off", "--root", lake.root]) == 0


def test_more_readers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "one\ntwo\n")
    assert [r["value"] for r in readers.zipped_lines(spark, str(tmp_path / "a.zip")).collect()] == ["one", "two"]
    f = spark.createDataFrame([("d1", "ok"), ("d1", "missing"), ("d2", "ok"), ("d2", "error"), ("d3", "ok")], "day string, state string")
    assert [r["day"] for r in readers.whole_days(f, 2).collect()] == ["d1"]
    (tmp_path / "r.csv").write_text("DATE,X\n2024-01-01,5.5\n2024-01-02,.\n")
    assert [r["percent"] for r in readers.rates_csv(spark, str(tmp_path / "r.csv")).orderBy("day").collect()] == [5.5, None]
