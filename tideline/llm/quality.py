"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is described by how often each pair of neighbouring character kinds stands
in it and by how much its words repeat, and encoded as h = tanh(W x + b). Gated attention, softmax of
w . (tanh(V h) * sigmoid(U h)) over the passages, weighs them; the weighted sum of encodings is the document's representation, which
a logistic layer scores. Encoder, attention and score are learned together from document labels alone, by gradient descent over a bounded
sample of labelled rows. Whole texts are read; nothing but the text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.shared import slices

#: Bytes of a passage; dimensions of an encoding and of the attention; labelled rows of either class that are learned from at most.
PASSAGE, WIDTH, GATE, SAMPLE = 1024, 16, 8, 1500
#: Passages of a labelled document that are learned from at most, spread evenly over it; a score always rests on all.
FITTED = 24
EPOCHS, RATE, DECAY = 150, 0.01, 1e-4
#: Kinds of bytes, by their characters; letters, digits and bytes of other characters have kinds of their own.
KINDS = [" ", "\n", "\t\r\v\f", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "'\"`", "-", "_/\\+=~^", ":;", "<>()[]{}", "@"]
N_KINDS = len(KINDS) + 5
STATS = 5


def kinds() -> np.ndarray:
    out = np.full(256, N_KINDS - 1, np.uint8)
    for k, chars in enumerate(KINDS):
        out[list(chars.encode())] = k
    for k, (a, b) in enumerate(((97, 123), (65, 91), (48, 58), (128, 256)), len(KINDS)):
        out[a:b] = k
    return out


KIND = kinds()


def describe(text: str | None) -> np.ndarray:
    """The passages of a text (null: empty, one passage) as rows of float32."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, -(-len(raw) // PASSAGE))
    pairs = N_KINDS * N_KINDS
    out = np.zeros((n, pairs + STATS), np.float32)
    if len(raw) > 1:
        kind = KIND[np.frombuffer(raw, np.uint8)].astype(np.int64)
        at = np.arange(len(raw) - 1) // PASSAGE * pairs + kind[:-1] * N_KINDS + kind[1:]
        counts = np.bincount(at, minlength=n * pairs).reshape(n, pairs).astype(np.float32)
        out[:, :pairs] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    for i in range(n):
        words = raw[i * PASSAGE : (i + 1) * PASSAGE].split()
        m = len(words)
        if m > 1:
            pair = set(zip(words, words[1:], strict=False))
            out[i, pairs:] = (len(set(words)) / m, sum(map(eq, words, words[1:])) / m, len(pair) / (m - 1), min(1.0, m / 200), 1.0)
        else:
            out[i, pairs:] = (1, 0, 1, 0, 0)
    return out


def some_passages(rows: np.ndarray) -> np.ndarray:
    """At most FITTED rows, evenly spread from the first to the last."""
    return rows if len(rows) <= FITTED else rows[np.linspace(0, len(rows) - 1, FITTED).round().astype(int)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.empty(0)
        x = np.concatenate(bags)
        return forward(self.p, (x - self.mean) * self.scale, starts(bags))["score"]


def starts(bags: list[np.ndarray]) -> np.ndarray:
    return np.r_[0, np.cumsum([len(b) for b in bags])[:-1]].astype(np.int64)


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All values of a pass over bags that begin at rows ``at``."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * s) @ p["w"]
    sizes = np.diff(np.r_[at, len(x)])
    top = np.repeat(np.maximum.reduceat(e, at), sizes)
    a = np.exp(e - top)
    a /= np.repeat(np.add.reduceat(a, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at)
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "sizes": sizes, "score": sigmoid(z @ p["v"] + p["c"])}


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 5) -> Model:
    """Adam over whole batches of the sample, gradients written out."""
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.01)
    x = ((x - mean) * scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {"W": rng.normal(0, d**-0.5, (d, WIDTH)), "b": np.zeros(WIDTH), "V": rng.normal(0, 0.3, (WIDTH, GATE)), "U": rng.normal(0, 0.3, (WIDTH, GATE)), "w": rng.normal(0, 0.3, GATE), "v": rng.normal(0, 0.3, WIDTH), "c": np.zeros(())}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    at, w = starts(bags), (weights / weights.sum()).astype(np.float32)
    for step in range(1, EPOCHS + 1):
        f = forward(p, x, at)
        g = (f["score"] - labels).astype(np.float32) * w
        gz = np.repeat(g[:, None] * p["v"], f["sizes"], 0)
        a, h, t, s = f["a"], f["h"], f["t"], f["s"]
        ga = (gz * h).sum(1)
        ge = a * (ga - np.repeat(np.add.reduceat(a * ga, at), f["sizes"]))
        gt, gs = ge[:, None] * p["w"] * s * (1 - t * t), ge[:, None] * p["w"] * t * s * (1 - s)
        gh = (gz * a[:, None] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
        grad = {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": (t * s).T @ ge, "v": f["z"].T @ g, "c": g.sum()}
        for k, v in p.items():
            now = grad[k] + DECAY * v
            first[k] = 0.9 * first[k] + 0.1 * now
            second[k] = 0.999 * second[k] + 0.001 * now * now
            p[k] = (v - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean.astype(np.float32), scale.astype(np.float32), p)


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0. A null id isn't held out."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """The model from at most ``sample`` labelled rows of either class (those with the least hash of the id) that aren't held out; none if a class is missing."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k_id"), F.col(label).cast("int").alias("y"))
    order = [F.xxhash64("k_id", F.lit(1)), F.col("k_id")]
    counts = {r["y"]: r["count"] for r in known.where("y in (0, 1)").groupBy("y").count().collect()}
    some = known.where("y = 0").orderBy(*order).limit(sample).union(known.where("y = 1").orderBy(*order).limit(sample))

    def run(batches):
        for b in batches:
            rows = [some_passages(describe(x.as_py())) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "y", "x"])

    # the sample's size and FITTED bound what is broadcast and what comes to the driver
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(some), F.col("id") == F.col("k_id")).select(F.col("id").cast("string").alias("id"), "y", "text")
    bags = sorted((r["id"], r["y"], bytes(r["x"])) for r in joined.mapInArrow(run, "id string, y int, x binary").collect())
    y = np.array([b[1] for b in bags], np.float32)
    if not 0 < y.sum() < len(y):
        return None
    x = [np.frombuffer(b[2], np.float32).reshape(-1, N_KINDS * N_KINDS + STATS) for b in bags]
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    return fit(x, y, np.array([share[int(k)] for k in y], np.float32))


def scored(docs: DataFrame, model: Model | None, columns: list[Column], text_col: str = "text") -> DataFrame:
    """The given columns of every row, then its score as the last column. Null texts count as empty; without a model every score is 0.5."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            score = np.concatenate([model.score([describe(x) for x in part]) for part in slices(texts, 1 << 21)] or [np.empty(0)]) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(score, pa.float64())], names=names)

    # columns go by their places, whatever their names
    plain = docs.select(F.col(text_col), *columns)
    plain = plain.toDF(*[f"c{i}" for i in range(len(plain.columns))])
    names = [*plain.columns[1:], "score"]
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[1:], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    id_col, text_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text")
    out = scored(docs, learn(docs, labels, **columns), [F.col(id_col)], text_col).toDF(id_col, "score")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """docs without the rows that score below the threshold; columns and rows that stay are as they were."""
    out = scored(docs, learn(docs, labels, **columns), [F.col(f"`{c}`") for c in docs.columns], columns.get("text_col", "text"))
    return out.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
