"""Dropping near-copies in order of arrival: a row is a copy of the first earlier accepted row that is like it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.functions.similarity import jaccard

#: Rows of a tile of queries.
TILE = 2048


def greedy_cosine(pending: DataFrame, recent: DataFrame, threshold: float = 0.87, by: Sequence[str] = (), key: str = "key", vector: str = "vector", at: str = "seen_at") -> DataFrame:
    """(by, key, duplicate_of): recent rows (newest first) are compared before rows accepted in this run.

    What a row is compared with depends on which rows before it were accepted, so a batch of a key is gone through in one task. Batches are what arrived
    since the last run; give ``by`` to part them.
    """
    both = recent.select(*by, key, vector, at, F.lit(0).alias("_new")).unionByName(pending.select(*by, key, vector, at, F.lit(1).alias("_new")))
    head = "".join(f"{b} {both.schema[b].dataType.simpleString()}, " for b in by)
    kind = both.schema[key].dataType.simpleString()

    def unit(v: object) -> np.ndarray:
        x = np.asarray(v, float)
        n = np.linalg.norm(x)
        return x / n if n else x

    def both_sides(*frames: pd.DataFrame):
        return (v for f in frames for v in f[vector])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["_new"] == 0].sort_values([at, key], ascending=[False, True])
        new = pdf[pdf["_new"] == 1].sort_values([at, key])
        names, held = old[key].tolist(), len(old)
        size = max((len(v) for v in both_sides(old, new)), default=0)
        refs = np.zeros((held + len(new), size))  # rows are filled as they are accepted
        for i, v in enumerate(old[vector]):
            refs[i] = unit(v)
        out = []
        for k, v in zip(new[key], new[vector], strict=True):
            x = unit(v)
            hits = np.flatnonzero(refs[:held] @ x >= threshold)
            out.append(names[hits[0]] if len(hits) else None)
            if not len(hits):
                refs[held] = x
                held += 1
                names.append(k)
        res = pd.DataFrame({key: new[key].to_numpy(), "duplicate_of": pd.Series(out, dtype="Int64" if kind in ("bigint", "int") else object)})
        for i, b in enumerate(by):
            res.insert(i, b, pdf[b].iloc[0])
        return res

    return both.withColumn("_all", F.lit(0)).groupBy(*(by or ["_all"])).applyInPandas(run, f"{head}{key} {kind}, duplicate_of {kind}")


def similar_to(queries: DataFrame, refs: DataFrame, threshold: float, key: str = "key", vector: str = "vector", tile: int = TILE) -> DataFrame:
    """(key, ref, similarity) of all pairs of a query and another row of refs whose cosine reaches the threshold, in blocks.

    The queries are dealt into tiles; each row of refs meets every tile, in tasks of about a tile of either side. A task multiplies two matrices
    of doubles, so none holds more than it was dealt. Null, empty and zero vectors, and vectors of other lengths, match nothing.
    """
    count = queries.count()
    tiles, slices = max(1, -(-count // tile)), max(1, -(-refs.count() // (8 * tile)))
    left = queries.select(F.lit(0).alias("side"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(tiles)).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"))
    right = refs.select(F.lit(1).alias("side"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("t"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("s"))
    kind = queries.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("ref", to_arrow_type(kind)), ("similarity", pa.float64())])

    def run(held: pa.Table) -> pa.Table:
        parts = []
        v = [x if x and None not in x else None for x in held.column("v").to_pylist()]
        side, k = held.column("side").to_numpy(), held.column("k").to_pylist()
        for n in {len(x) for x in v if x}:
            a, b = ([i for i, x in enumerate(v) if x and len(x) == n and side[i] == s] for s in (0, 1))
            with np.errstate(all="ignore"):
                x, y = (np.array([v[i] for i in p]).reshape(-1, n) for p in (a, b))
                x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
                near = x @ y.T
            i, j = np.nonzero(near >= threshold)
            parts += [(k[a[p]], k[b[q]], near[p, q]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if k[a[p]] != k[b[q]]]
        return pa.table(list(map(list, zip(*parts, strict=True))) or [[], [], []], schema=schema)

    return left.unionByName(right).groupBy("t", "s").applyInArrow(run, f"{key} {kind.simpleString()}, ref {kind.simpleString()}, similarity double")


def jaccard_join(sets: DataFrame, threshold: float, key: str = "key", words: str = "w") -> DataFrame:
    """(a, b, jaccard), a < b: pairs of sets (arrays of distinct words) whose Jaccard similarity reaches the threshold, above 0.

    Sets of n words that are so alike share one of the rarest n - ceil(threshold * n) + 1 words of either (by number of sets, then by
    name), so only sets that share such a word, and are of like sizes, are compared. Empty and null sets match nothing.
    """
    each = sets.select(F.col(key).alias("k"), F.explode(words).alias("x"))
    rare = each.groupBy("x").agg(F.count("*").alias("n"))
    ranked = each.join(rare, "x").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s"))
    size = F.size("s")
    keep = size - F.ceil(F.lit(threshold) * size - 1e-9) + 1
    held = ranked.select("k", F.transform("s", lambda e: e["x"]).alias("w"), size.alias("n"), keep.cast("int").alias("keep"))
    tokens = held.select("k", "n", F.explode(F.slice("w", 1, F.col("keep"))).alias("t"))
    a, b = tokens.select(F.col("k").alias("a"), F.col("n").alias("na"), "t"), tokens.select(F.col("k").alias("b"), F.col("n").alias("nb"), "t")
    like = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "t").where(like).select("a", "b").distinct()
    left, right = held.select(F.col("k").alias("a"), F.col("w").alias("wa")), held.select(F.col("k").alias("b"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("jaccard")).where(F.col("jaccard") >= threshold)
