"""Jobs over a data folder, as ``python -m tideline.jobs NAME --root FOLDER [--asset A] ...``.

The folder has raw/ (klines, funding, metrics, dvol, onchain, macro, stablecoins, etf, fng, gkg as parquet, each with an asset column where
it is by asset), news/ (the store), features/, labels/, trials/. Landing jobs, which fetch, are not part of this.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import bars, labels, matrix, news
from tideline.operators import windows as W
from tideline.plans import dataset, gates, training
from tideline.plans.registry import Registry
from tideline.plans.store import Store
from tideline.plans.switch import Switch
from tideline.sources import contract, readers, sinks
from tideline.streaming import flows

HORIZONS = {"24h": 24, "96h": 96}
ONCHAIN = ("AdrActCnt", "TxCnt", "HashRate", "CapMrktCurUSD", "CapMVRVCur")
FRESH_HOURS = {"klines": ("open_time", 48.0), "funding": ("funding_time", 48.0), "onchain": ("published_at", 96.0), "gkg": ("file_time", 48.0)}


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def raw(self, name: str) -> DataFrame | None:
        """A raw table, or None where it wasn't landed."""
        p = self.path("raw", name)
        return readers.parquet(self.spark, p, tolerant=name == "gkg") if sinks.exists(self.spark, p) else None

    def store(self) -> Store:
        return Store(self.spark, self.path("news"))

    def switch(self) -> Switch:
        return Switch(self.path("models.flag"))


def build_matrix(lake: Lake, today: object = None) -> DataFrame:
    """The matrix of all assets, from whatever blocks are there; checked for repeated rows and written."""
    daily = bars.price_features(bars.to_daily(lake.raw("klines")))
    blocks = {n: f(raw) for n, f in (("funding", bars.funding_daily), ("metrics", bars.metrics_daily), ("dvol", bars.dvol_daily)) if (raw := lake.raw(n)) is not None}
    published = []
    if (t := lake.raw("onchain")) is not None:
        published.append(matrix.Published(t, ONCHAIN, "oc", matrix.CAPS["onchain"]))
    if (t := lake.raw("macro")) is not None:
        published += matrix.macro_blocks(t, sorted(r[0] for r in t.select("series").distinct().collect()))  # some ten series
    if (t := lake.raw("stablecoins")) is not None:
        published.append(matrix.Published(t.where("series = 'total_usd'"), ["value"], "stable_total", matrix.CAPS["stablecoins"], ()))
    if (t := lake.raw("etf")) is not None:
        flows_ = t.groupBy("asset", "published_at").agg(F.coalesce(F.sum("flow_musd"), F.lit(0.0)).alias("flow_total_musd"))
        published.append(matrix.Published(flows_, ["flow_total_musd"], "etf", matrix.CAPS["etf"]))
    if (t := lake.raw("fng")) is not None:
        published.append(matrix.Published(readers.published_after(t, "date", 1), ["fng_value"], "fng", matrix.CAPS["fng"], ()))
    out = matrix.assemble(daily, blocks, published, news_features(lake), today=today)
    matrix.check_unique(out)
    sinks.replace(out, lake.path("features", "matrix"))
    return lake.spark.read.parquet(lake.path("features", "matrix"))


def news_features(lake: Lake) -> DataFrame | None:
    """Both eras by asset and decision day, with abnormal attention; None without news."""
    parts = []
    assets = [r[0] for r in lake.raw("klines").select("asset").distinct().collect()]  # the universe: a few
    if (g := lake.raw("gkg")) is not None:
        for a in assets:
            parts.append(news.tone_daily(g.where(F.col("assets").contains(a))).withColumn("asset", F.lit(a)))
    store = lake.store()
    articles, scores = store.table("articles"), store.table("scores")
    if not scores.isEmpty():
        for a in assets:
            parts.append(news.scored_daily(news.with_clock(news.latest_scored(articles, scores, a))).withColumn("asset", F.lit(a)))
    if not parts:
        return None
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    first = F.row_number().over(W.series(["asset", "decision_day"], "era_llm"))
    one = both.withColumn("_n", first).where("_n = 1").drop("_n")
    return news.abnormal_attention(one, by=["asset"])


def generate_labels(lake: Lake, mult: float = 1.5) -> dict[str, DataFrame]:
    """Labels of all assets for each horizon, with one sampling threshold for a horizon; summaries by horizon."""
    out = {}
    raw = lake.raw("klines").select("asset", "open_time", "high", "low", "close")
    for name, hours in HORIZONS.items():
        made = labels.generate(raw, labels.Barriers(mult, mult, hours))
        path = lake.path("labels", f"{name}{labels.variant_suffix(mult)}")
        sinks.replace(made, path)
        out[name] = labels.summary(lake.spark.read.parquet(path))
    return out


def train(lake: Lake, horizon: str = "24h", blocks: tuple[str, ...] = ("price",), params: dict | None = None) -> DataFrame:
    frame, names = dataset.training_frame(lake.spark.read.parquet(lake.path("labels", horizon)), lake.spark.read.parquet(lake.path("features", "matrix")))
    return training.evaluate(frame, dataset.block_features(names, blocks), params, registry=Registry(lake.spark, lake.path("trials")), identity={"phase": "4.2", "model": "gbt", "horizon": horizon})


def validate_regime(lake: Lake, asset: str) -> dict:
    outcomes = gates.forward_outcomes(lake.raw("klines").where(F.col("asset") == asset))
    return gates.validate(lake.spark.read.parquet(lake.path("features", "regime_daily")), outcomes)


def status(lake: Lake) -> dict:
    """Rows of each raw table, the store's state, and trials."""
    names = ("klines", "funding", "metrics", "dvol", "onchain", "macro", "stablecoins", "etf", "fng", "gkg")
    return {"rows": {n: t.count() for n in names if (t := lake.raw(n)) is not None}, "store": lake.store().stats(), "trials": Registry(lake.spark, lake.path("trials")).count(), "models": lake.switch().status()}


def freshness(lake: Lake, now) -> DataFrame | None:
    tables = {n: (t, at, hours) for n, (at, hours) in FRESH_HOURS.items() if (t := lake.raw(n)) is not None}
    return flows.freshness(tables, now) if tables else None


def daily_update(lake: Lake, today: object = None) -> dict:
    """Matrix, then coverage of its blocks; scoring isn't run where models are off."""
    built = build_matrix(lake, today)
    found = matrix.coverage(built, {"funding": "funding_", "positioning": "oi_", "iv": "iv_", "onchain": "oc_", "macro": "macro_", "news": "news_"})
    return {"rows": built.count(), "coverage": [r.asDict() for r in found.collect()]}


def export_contract(lake: Lake, out: str) -> None:
    blocks = {n: t for n in ("klines", "funding", "metrics", "dvol", "onchain") if (t := lake.raw(n)) is not None}
    contract.export(contract.build(blocks, "tideline.jobs"), out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["build-matrix", "generate-labels", "train", "validate-regime", "status", "daily-update", "export-contract", "models-on", "models-off", "models-status"])
    p.add_argument("--root", required=True)
    p.add_argument("--asset", default="BTC")
    p.add_argument("--horizon", default="24h", choices=list(HORIZONS))
    p.add_argument("--hours", type=float, default=8.0)
    p.add_argument("--out", default="contract.json")
    a = p.parse_args(argv)
    if a.job.startswith("models-"):
        s = Switch(f"{a.root.rstrip('/')}/models.flag")
        print({"models-on": lambda: s.on(a.hours), "models-off": s.off, "models-status": s.status}[a.job]())
        return 0
    from tideline.session import session

    lake = Lake(session(), a.root)
    if a.job == "generate-labels":
        for name, s in generate_labels(lake).items():
            print(name)
            s.show()
    elif a.job == "train":
        train(lake, a.horizon, tuple(dataset.BLOCKS)).show()
    elif a.job == "validate-regime":
        print(gates.report(validate_regime(lake, a.asset)))
    elif a.job == "export-contract":
        export_contract(lake, a.out)
    elif a.job == "build-matrix":
        print(build_matrix(lake).count())
    else:
        print(json.dumps({"status": status, "daily-update": daily_update}[a.job](lake), default=str, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
