"""Models on training frames with MLlib: purged evaluation, ablations, random search, stable features, meta-labelling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.stats import matthews
from tideline.plans.cv import purged_kfold
from tideline.plans.dataset import BLOCKS, block_features

BASE = {"maxDepth": 4, "maxIter": 60, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 100, "featureSubsetStrategy": "0.5", "seed": 42}


def prepared(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds id, y and the feature vector; nulls and NaN become 0, booleans numbers."""
    clean = {f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features}
    out = frame.withColumns(clean).withColumns({"y": (F.col("label") == 1).cast("double"), "id": F.xxhash64("asset", "t0_time", "t1_time")})
    return VectorAssembler(inputCols=list(features), outputCol="x").transform(out)


def out_of_fold(rows: DataFrame, params: dict, folds: int = 5, embargo: str = "interval 22 days") -> DataFrame:
    """(id, split, p): the chance of label 1 from the model that didn't see the event or what overlaps it."""
    roles = purged_kfold(rows.select("id", F.col("t0_time").alias("t0"), F.col("t1_time").alias("t1")), folds, embargo).cache()
    out = None
    for k in range(folds):
        part = rows.join(roles.where(F.col("split") == k), "id")
        model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="sample_weight", **params).fit(part.where("role = 'train'"))
        p = model.transform(part.where("role = 'test'")).select("id", "split", vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionAll(p)
    return out


def fold_metrics(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """(split, n_test, acc, mcc, hit_ret, mean_ret)."""
    joined = rows.join(scored, "id").withColumn("pred", (F.col("p") >= 0.5).cast("int")).withColumn("side_ret", F.when(F.col("pred") == 1, F.col("ret")).otherwise(-F.col("ret")))
    y = F.col("y").cast("int")
    return joined.groupBy("split").agg(F.count("*").alias("n_test"), F.avg((F.col("pred") == y).cast("double")).alias("acc"), matthews(y, F.col("pred")).alias("mcc"), F.avg((F.col("side_ret") > 0).cast("double")).alias("hit_ret"), F.avg("side_ret").alias("mean_ret"))


def evaluate(frame: DataFrame, features: Sequence[str], params: dict | None = None, folds: int = 5, embargo: str = "interval 22 days", registry=None, identity: dict | None = None) -> DataFrame:
    """Fold metrics of one configuration; with a registry the intent is registered before and the result after."""
    if not features:
        raise ValueError("no features")
    params = BASE | (params or {})
    if registry:
        known = {"phase": "4.2", "model": "gbt", "horizon": "24h"} | (identity or {})
        config = {"features": list(features), "params": params, "folds": folds, "embargo": embargo}
        registry.register(config=config, **known)
    rows = prepared(frame, features)
    out = fold_metrics(rows, out_of_fold(rows, params, folds, embargo))
    if registry:
        out = out.cache()
        registry.log(config=config, metrics={"folds": [r.asDict() for r in out.collect()]}, **known)
    return out


def ablations(frame: DataFrame, names: Sequence[str], params: dict | None = None, **options) -> dict[str, DataFrame]:
    """Each block alone, and all but one."""
    blocks = [b for b in BLOCKS if block_features(names, [b])]
    sets = {f"only_{b}": [b] for b in blocks} | {f"without_{b}": [x for x in blocks if x != b] for b in blocks if len(blocks) > 1}
    return {k: evaluate(frame, block_features(names, v), params, **options) for k, v in sets.items()}


def random_search(frame: DataFrame, features: Sequence[str], trials: int = 40, seed: int = 42, **options) -> tuple[dict, float]:
    """The parameters with the best mean MCC of those drawn, and that MCC."""
    rng, best = random.Random(seed), ({}, float("-inf"))
    for _ in range(trials):
        params = {"maxDepth": rng.randint(3, 5), "stepSize": 10 ** rng.uniform(-1.7, -1.0), "maxIter": rng.randrange(20, 101, 20), "minInstancesPerNode": rng.randrange(50, 201, 25), "featureSubsetStrategy": f"{rng.uniform(0.3, 0.7):.2f}"}
        mcc = evaluate(frame, features, params, **options).agg(F.avg("mcc")).first()[0]
        best = max(best, (params, mcc), key=lambda x: x[1])
    return best


def stable_features(frame: DataFrame, features: Sequence[str], params: dict | None = None, folds: int = 5, top: int = 60, worst: int = 80, embargo: str = "interval 22 days") -> list[str]:
    """Features whose importance ranks at most ``worst`` in every fold's training part, by mean rank."""
    rows = prepared(frame, features)
    roles = purged_kfold(rows.select("id", F.col("t0_time").alias("t0"), F.col("t1_time").alias("t1")), folds, embargo).cache()
    ranks: dict[str, list[int]] = {f: [] for f in features}
    for k in range(folds):
        part = rows.join(roles.where((F.col("split") == k) & (F.col("role") == "train")), "id")
        weight = GBTClassifier(featuresCol="x", labelCol="y", weightCol="sample_weight", **(BASE | (params or {}))).fit(part).featureImportances.toArray()
        for r, i in enumerate(sorted(range(len(features)), key=lambda i: (-weight[i], i))):
            ranks[features[i]].append(r)
    kept = sorted((sum(r) / len(r), f) for f, r in ranks.items() if max(r) <= worst)
    return [f for _, f in kept[:top]]


def meta_labels(frame: DataFrame, features: Sequence[str], slow: Sequence[str], params: dict | None = None, folds: int = 5, embargo: str = "interval 22 days", gate: float = 0.55, c: float = 0.5) -> DataFrame:
    """(split, n_test, primary_hit, gated_hit, coverage): a second model says when to follow the first one's side.

    Its training signal comes from folds inside the outer training part, so nothing it learns from has seen the test fold.
    """
    params = BASE | (params or {})
    rows = prepared(frame, features).cache()
    roles = purged_kfold(rows.select("id", F.col("t0_time").alias("t0"), F.col("t1_time").alias("t1")), folds, embargo).cache()
    outer = out_of_fold(rows, params, folds, embargo).cache()
    meta = VectorAssembler(inputCols=["p", *[f"_{s}" for s in slow]], outputCol="mx")
    zero = {f"_{s}": F.coalesce(F.nanvl(F.col(s).cast("double"), F.lit(0.0)), F.lit(0.0)) for s in slow}

    def signalled(part: DataFrame, p: DataFrame) -> DataFrame:
        side = F.when(F.col("p") >= 0.5, 1.0).otherwise(-1.0)
        return meta.transform(part.join(p.select("id", "p"), "id").withColumns(zero).withColumn("side_ret", side * F.col("ret")).withColumn("won", (F.col("side_ret") > 0).cast("double")))

    out = None
    for k in range(folds):
        train = rows.join(roles.where((F.col("split") == k) & (F.col("role") == "train")).select("id"), "id")
        learn = signalled(train, out_of_fold(train, params, max(2, folds - 1), embargo)).cache()
        stats = learn.agg(F.min("won"), F.max("won"), F.count("*")).first()
        if stats[0] == stats[1]:
            continue
        model = LogisticRegression(featuresCol="mx", labelCol="won", regParam=1 / (c * stats[2]), standardization=False, maxIter=200).fit(learn)
        test = model.transform(signalled(rows, outer.where(F.col("split") == k))).withColumn("keep", vector_to_array("probability")[1] >= gate)
        hit = (F.col("side_ret") > 0).cast("double")
        row = test.agg(F.lit(k).alias("split"), F.count("*").alias("n_test"), F.avg(hit).alias("primary_hit"), F.when(F.count_if("keep") >= 10, F.avg(F.when(F.col("keep"), hit))).alias("gated_hit"), F.avg(F.col("keep").cast("double")).alias("coverage"))
        out = row if out is None else out.unionAll(row)
    return out


def uplift(folds: DataFrame) -> DataFrame:
    """(n_paired, primary_hit, gated_hit, uplift) over folds that have both."""
    return folds.where("gated_hit is not null").agg(F.count("*").alias("n_paired"), F.avg("primary_hit").alias("primary_hit"), F.avg("gated_hit").alias("gated_hit"), (F.avg("gated_hit") - F.avg("primary_hit")).alias("uplift"))


def probability_up(levels: Sequence[float], values: str, last: str):
    """Share of a forecast above the last value, by linear interpolation on a grid of quantiles (column: array of their values)."""
    grid = F.array(*[F.lit(float(x)) for x in levels])
    v, x = F.col(values), F.col(last)
    pairs = F.zip_with(v, grid, lambda a, q: F.struct(a.alias("v"), q.alias("q")))
    below, above = F.filter(pairs, lambda p: p["v"] <= x), F.filter(pairs, lambda p: p["v"] > x)
    lo, hi = F.element_at(below, -1), F.element_at(above, 1)
    inside = lo["q"] + (hi["q"] - lo["q"]) * (x - lo["v"]) / (hi["v"] - lo["v"])
    return 1.0 - F.when(F.size(below) == 0, F.lit(float(levels[0]))).when(F.size(above) == 0, F.lit(float(levels[-1]))).otherwise(inside)
