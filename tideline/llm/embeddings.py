"""Embedding near-dedup by randomly rotated binary codes with correction factors.

Every vector is scaled to length one and rotated by one random rotation. Its code keeps the rotated vector's signs, one bit a
dimension, and the factor f, the inner product of the vector with its code's unit vector. The inner product of
another vector q with the code, over f, estimates the cosine without bias; its error stays below
EPSILON * sqrt((1 - f^2) / (f^2 (d - 1))) but for a chance that falls as exp(-c EPSILON^2). The other vector is rounded at random to
QUANT bits a dimension, so the product is counted on bit planes. Only pairs whose upper bound reaches the
threshold are computed again, in double precision.

Equal vectors are one class with a count. The classes of a label are dealt by a hash into tiles, and each pair of a label's
tiles is a task of its own, so a label that holds most rows spreads over many tasks. Tiles grow with the label, up to a bound in bytes, so that a vector is
sent to few of them. Work grows with the square of a label's
distinct vectors, as any search without loss over unclustered vectors does; codes make the pair cost a few
word operations. Tasks emit each vector's number of links in the task, and a tree for each component.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.components import components, local_labels, tree_edges
from tideline.llm.shared import fresh_key, written

#: Vectors of a tile and of a block that is compared at once, bits of a rounded dimension, and half-widths of the confidence bound.
TILE, BLOCK, QUANT, EPSILON = 4096, 1024, 4, 4.0
#: A label's vectors are dealt into at least so many tiles before tiles grow, and a tile grows to so many bytes of doubles: a vector is sent to every tile of its label.
TILES, TILE_BYTES = 16, 1 << 24


@lru_cache(maxsize=4)
def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


class Codes:
    """Codes of unit vectors (rows)."""

    def __init__(self, unit: np.ndarray):
        self.unit, self.d = unit, unit.shape[1]
        turned = unit @ rotation(self.d).T
        self.words = -(-self.d // 64)
        self.bits = self._pack(turned > 0)
        self.ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.factor = np.abs(turned).sum(1) / np.sqrt(self.d)
        # rounded up or down at random, so that the rounding has no bias
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << QUANT) - 1), 1e-12)
        dither = np.random.default_rng(3).random(turned.shape)
        whole = np.clip(np.floor((turned - self.low[:, None]) / self.step[:, None] + dither), 0, (1 << QUANT) - 1).astype(np.int64)
        self.planes = [self._pack(whole >> i & 1 == 1) for i in range(QUANT)]
        self.sum = whole.sum(1)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bits), self.words * 8), np.uint8)
        packed = np.packbits(bits, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view("<u8")

    def estimate(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of self's rounded vectors (rows) with other's codes (columns), and the bounds of their errors (by column)."""
        root = np.sqrt(self.d)
        dot = np.zeros((len(self.unit), len(other.unit)), np.float32)
        for i, plane in enumerate(self.planes):
            for w in range(self.words):
                dot += np.bitwise_count(plane[:, w, None] & other.bits[None, :, w]).astype(np.float32) * np.float32(1 << i)
        # sum over dimensions of (low + step * whole) * (2 bit - 1) / sqrt(d)
        low, step = self.low[:, None], self.step[:, None]
        product = (2 * (step * dot + low * other.ones[None, :]) - (step * self.sum[:, None] + self.d * low)) / root
        f = other.factor[None, :]
        return product / f, EPSILON * np.sqrt(np.maximum(0, 1 - f * f) / (f * f * max(1, self.d - 1)))


def linked(a: Codes, b: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose cosine in double precision reaches the threshold."""
    found, bound = a.estimate(b)
    i, j = np.nonzero(found + bound + 2 * np.sqrt(a.d) * float(a.step.max(initial=0)) / 8 >= threshold)
    sure = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        sure[part] = np.einsum("ij,ij->i", a.unit[i[part]], b.unit[j[part]])
    keep = sure >= threshold
    return i[keep], j[keep]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: cosine links of at least threshold within a label.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link with
    nothing; lengths that differ don't link. A row is kept if its id is the smallest of its component; a component id names ids
    that aren't null. Repeated rows come out as often as they come in.
    """
    v = F.col("v")
    usable = F.expr("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # vectors whose two hashes of 64 bits agree count as equal
    hashes = F.concat(*[F.hex(F.xxhash64(F.lit(i), "label", "v")) for i in (0, 1)])
    rows = rows.withColumn("digest", F.when(F.col("ok"), hashes))
    rows = written(rows, "vectors")
    classes = rows.where("ok").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    most = F.greatest(F.lit(TILE_BYTES) / (8 * F.max(F.size("v"))), F.lit(256.0))
    of = classes.groupBy("label").agg(F.count("*").alias("count"), most.alias("most"))
    size = F.least(F.col("most"), F.greatest(F.lit(float(tile)), F.col("count") / TILES))
    sizes = of.select(F.col("label").alias("of"), F.ceil(F.col("count") / size).cast("int").alias("g"))
    dealt = classes.join(sizes, F.col("label") == F.col("of")).withColumn("mine", F.expr("cast(pmod(xxhash64(node), g) as int)"))
    # a task for each pair of tiles; one of a tile with itself, too
    tasks = dealt.select("label", "mine", "node", "n", "v", F.explode(F.expr("sequence(0, g - 1)")).alias("other"))
    tasks = tasks.select(F.xxhash64("label", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), F.col("label").cast("string").alias("label"), (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") >= F.col("other")).alias("second"), "node", "n", "v")

    def run(held: pa.Table) -> pa.Table:
        out = {"u": [], "v": [], "more": []}
        names, first, second = (held.column(x).to_pylist() for x in ("label", "first", "second"))
        node, n, lists = held.column("node").to_numpy(), held.column("n").to_numpy(), held.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat, begins = lists.flatten().to_numpy().astype(np.float64), np.r_[0, np.cumsum(sizes)[:-1]]
        groups: dict[tuple, list[int]] = {}
        for i, (name, d) in enumerate(zip(names, sizes.tolist(), strict=True)):
            groups.setdefault((name, d), []).append(i)
        for (_, d), members in groups.items():
            members = np.array(members)
            x = flat[begins[members][:, None] + np.arange(d)]
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            a, b = np.flatnonzero(np.array(first)[members]), np.flatnonzero(np.array(second)[members])
            m, same = len(members), len(a) == len(b) == len(members)
            weight, more, label = n[members], np.zeros(len(members), np.int64), np.arange(len(members))
            blocks = lambda at: [(p, Codes(x[p])) for p in (at[k : k + BLOCK] for k in range(0, len(at), BLOCK))]  # noqa: E731, B023
            left = blocks(a)
            right = left if same else blocks(b)
            for k, (p, one) in enumerate(left):
                for q, two in right[k:] if same else right:
                    i, j = linked(one, two, threshold)
                    i, j = p[i], q[j]
                    if one is two:
                        # a block with itself finds each pair from either side (or by chance from one: the codes differ)
                        pair = np.unique(np.minimum(i, j)[i != j] * m + np.maximum(i, j)[i != j])
                        i, j = pair // m, pair % m
                    np.add.at(more, i, weight[j])
                    np.add.at(more, j, weight[i])
                    label = local_labels(m, i, j, label)
            u, v = tree_edges(label)
            hit = np.flatnonzero(more)
            out["u"] += [node[members[u]], node[members[hit]]]
            out["v"] += [node[members[v]], node[members[hit]]]
            out["more"] += [np.zeros(len(u), np.int64), more[hit].astype(np.int64)]
        return pa.table({k: np.concatenate(x) if x else np.empty(0, np.int64) for k, x in out.items()}, schema=pa.schema([(k, pa.int64()) for k in out]))

    found = written(tasks.groupBy("task").applyInArrow(run, "u long, v long, more long"), "links")
    label = components(found.where("u <> v").select("u", "v")).withColumnRenamed("label", "comp")
    counts = found.where("u = v").groupBy("u").agg(F.sum("more").alias("more")).withColumnRenamed("u", "node")
    member = classes.select("digest", "node", "least", "n").join(label, "node", "left").join(counts, "node", "left")
    member = written(member.withColumn("comp", F.coalesce("comp", "node")), "members")
    named = written(member.groupBy("comp").agg(F.min("least").alias("component_id")), "named").select(fresh_key("comp").alias("key"), "component_id")
    of = written(member.join(named, member["comp"] == named["key"]).select(F.col("digest").alias("key"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "of")
    out = rows.join(of, rows["digest"] == of["key"], "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
