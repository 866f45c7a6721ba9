"""URL filter: rules first, then a ratio of two character language models.

Each model is a smoothed Markov model of variable order: the chance of a character after the longest contexts seen is mixed
with that after shorter ones, each context weighing by how many different characters have followed it (Witten-Bell), down
to a uniform chance. One model is learned from all accepted URLs, one from all rejected ones, but for a fifth of them; a URL's score is the
difference of their log-likelihoods over its length, and it is allowed from a threshold on. The threshold is calibrated on the
fifth that wasn't learned from, where the shares of wrongly blocked and wrongly allowed ones are least in sum.

Characters are taken as the bytes of their UTF-8, so all are kept apart and a context is ORDER bytes. A context with the byte after it is one whole number,
and counts are a table of numbers that grows with the URLs. While it has at most MODEL_ROWS rows it is broadcast as sorted arrays and URLs are scored where
they are. Beyond that, only contexts that stand before at least one in HOT of all bytes are broadcast, which are few whatever the table's size; places
whose longer contexts are rarer than that are joined with the counts. Both give the same scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import written

#: Longest context, rows of counts that are broadcast at most (16 bytes each), and URLs scored or counted at once.
ORDER, MODEL_ROWS, BATCH = 5, 3_000_000, 2000
#: Contexts before at least one in HOT of a model's bytes are broadcast: at most HOT for each length, each with at most 256 bytes after it.
HOT = 1000
#: Scores are calibrated in steps of this size.
STEP = 1e-4
#: Bits of a byte, and the marks of a URL's start and end: bytes that UTF-8 never has.
BITS, START, END = 8, 0xFE, 0xFF
UNIFORM = 1 / 256


#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null one or one without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else null; of equally long ones the first by name."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def symbols(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """URLs (null: empty) one after the other as numbers, each after ORDER start marks and before an end mark; and the places of their bytes and ends."""
    parts, places, at = [], [], 0
    head = np.full(ORDER, START, np.int64)
    for u in urls:
        code = np.frombuffer((u or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
        parts += [head, code, [END]]
        places.append(np.arange(at + ORDER, at + ORDER + len(code) + 1))
        at += ORDER + len(code) + 1
    return np.concatenate(parts).astype(np.int64), np.concatenate(places)


def contexts(s: np.ndarray, at: np.ndarray):
    """For each length of context, its number before each place: the length, then the bytes, the nearest last."""
    context = np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        if k:
            context = context | s[at - k] << BITS * (k - 1)
        yield k, np.int64(k) << BITS * ORDER | context


def keys(urls: list[str | None]) -> np.ndarray:
    """The number of every context with the byte after it, of all lengths."""
    s, at = symbols(urls)
    return np.concatenate([c << BITS | s[at] for _, c in contexts(s, at)])


class Markov:
    """A model from counts by key."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = key[order], n[order].astype(np.int64)
        # by context: characters in all, and different ones
        self.context, first = np.unique(self.key >> BITS, return_index=True)
        self.kinds = np.diff(np.r_[first, len(key)])
        self.total = np.add.reduceat(self.n, first) if len(key) else self.n

    @classmethod
    def learned(cls, urls: list[str]) -> Markov:
        return cls(*np.unique(keys(urls), return_counts=True)) if urls else cls(np.empty(0, np.int64), np.empty(0, np.int64))

    def chances(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The chance of each place's byte."""
        return self.steps(s, at)[0]

    def steps(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The chance of each place's byte, and for each length of context whether the model has it."""
        p, known = np.full(len(at), UNIFORM), []
        for _, c in contexts(s, at):
            if not len(self.key):
                known.append(np.zeros(len(at), bool))
                continue
            i = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
            seen = self.context[i] == c  # where a context was seen, so were all shorter ones
            k = c << BITS | s[at]
            j = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            n = np.where(self.key[j] == k, self.n[j], 0)
            p = np.where(seen, (n + self.kinds[i] * p) / (self.total[i] + self.kinds[i]), p)
            known.append(seen)
        return p, known


def ratios(allow: Markov, block: Markov, urls: list[str | None]) -> np.ndarray:
    """Scores of URLs: log-likelihood by one model less that by the other, over the length with the end."""
    out = []
    for b in range(0, len(urls), BATCH):
        part = urls[b : b + BATCH]
        s, at = symbols(part)
        x = np.log(allow.chances(s, at)) - np.log(block.chances(s, at))
        sizes = np.array([len((u or "").encode("utf-8", "surrogatepass")) + 1 for u in part])
        out.append(np.add.reduceat(x, np.cumsum(sizes) - sizes) / sizes)
    return np.concatenate(out) if out else np.empty(0)


def calibrated(scores: list[tuple[float, int, int]]) -> float:
    """The threshold with the least sum of the shares of allowed ones below and blocked ones from it on, of (score, allowed, blocked); the middle between two scores, 0 without both kinds."""
    good, bad = sum(a for _, a, _ in scores), sum(b for _, _, b in scores)
    if not good or not bad:
        return 0.0
    scores = sorted(scores)
    # from a threshold below all scores on, every blocked one is allowed
    lost, passed, best, at = 0, bad, 1.0, scores[0][0] - STEP / 2
    for i, (s, a, b) in enumerate(scores):
        lost, passed = lost + a, passed - b
        cost = lost / good + passed / bad
        if cost < best:
            best, at = cost, (s + scores[i + 1][0]) / 2 if i + 1 < len(scores) else s + STEP / 2
    return at


def counts(labelled: DataFrame) -> DataFrame:
    """(allow, key, n) of all URLs of labelled(url, allow): summed within batches, then over them."""

    def run(batches):
        for b in batches:
            allow = np.array(b.column(1).to_pylist(), bool)
            urls = np.array(b.column(0).to_pylist(), object)
            for at in range(0, len(urls), BATCH):
                for side in (True, False):
                    part = urls[at : at + BATCH][allow[at : at + BATCH] == side].tolist()
                    if part:
                        key, n = np.unique(keys(part), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([side] * len(key), pa.bool_()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["allow", "key", "n"])

    made = labelled.select("url", "allow").mapInArrow(run, "allow boolean, key long, n long")
    return written(made.groupBy("allow", "key").agg(F.sum("n").alias("n")), "counts")


def sides(model: DataFrame) -> list[Markov]:
    """The models of accepted and rejected URLs from counts of a bounded number."""
    held = model.toPandas()
    allow = held["allow"].astype(bool)
    return [Markov(p["key"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for p in (held[allow], held[~allow])]


def scored(rows: DataFrame, model: DataFrame, url: str = "url", broadcast_rows: int = MODEL_ROWS) -> DataFrame:
    """rows with the score of their URL (null: empty) by counts()."""
    if model.count() > broadcast_rows:
        return scored_by_join(rows, model, url)
    told = rows.sparkSession.sparkContext.broadcast(sides(model))

    @F.pandas_udf("double")
    def score(urls):
        import pandas as pd

        return pd.Series(ratios(*told.value, urls.tolist()), dtype="float64")

    return rows.withColumn("score", score(F.coalesce(url, F.lit(""))))


#: A place whose context isn't hot: the side, the place, the context's length and number, its number with the byte after it, and the chance by hot contexts alone.
DEEP = pa.struct([("allow", pa.bool_()), ("at", pa.int32()), ("k", pa.int32()), ("context", pa.int64()), ("key", pa.int64()), ("base", pa.float64())])


def scored_by_join(rows: DataFrame, model: DataFrame, url: str = "url") -> DataFrame:
    """As scored(), for models of any size: hot contexts are broadcast, and only places with other contexts meet the counts by a join."""
    totals = model.groupBy("allow", F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    totals = written(totals, "totals")
    # the empty context stands before every byte
    every = totals.where("context = 0").select(F.col("allow").alias("side"), F.col("total").alias("all"))
    hot = totals.join(F.broadcast(every), F.col("allow") == F.col("side")).where(F.col("total") * HOT >= F.col("all")).select(F.col("allow").alias("h_allow"), F.col("context").alias("h_context"))
    known = model.join(F.broadcast(hot), (F.col("allow") == F.col("h_allow")) & (F.shiftright("key", BITS) == F.col("h_context"))).select("allow", "key", "n")
    told = rows.sparkSession.sparkContext.broadcast(sides(known))

    def spread(batches):
        for b in batches:
            for part in (b.slice(at, BATCH) for at in range(0, b.num_rows, BATCH)):
                urls = part.column(0).to_pylist()
                s, at = symbols(urls)
                sizes = np.array([len(u.encode("utf-8", "surrogatepass")) + 1 for u in urls])
                begins, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(urls)), sizes)
                score, deep = np.zeros(len(at)), []
                for allow, m in zip((True, False), told.value, strict=True):
                    p, seen = m.steps(s, at)
                    score += np.log(p) if allow else -np.log(p)
                    for k, c in contexts(s, at):
                        i = np.flatnonzero(~seen[k])
                        deep.append((owner[i], np.full(len(i), allow), i - begins[owner[i]], np.full(len(i), k), c[i], c[i] << BITS | s[at[i]], p[i]))
                columns = [np.concatenate(x) for x in zip(*deep, strict=True)]
                order = np.argsort(columns[0], kind="stable")
                held = pa.StructArray.from_arrays([pa.array(x[order], f.type) for x, f in zip(columns[1:], DEEP, strict=True)], fields=list(DEEP))
                ends = np.r_[0, np.cumsum(np.bincount(columns[0], minlength=len(urls)))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.add.reduceat(score, begins)), pa.array(sizes, pa.int64()), lists], names=["id", "s", "size", "deep"])

    distinct = written(rows.select(F.coalesce(url, F.lit("")).alias("u")).distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    places = written(distinct.mapInArrow(spread, "id long, s double, size long, deep array<struct<allow boolean, at int, k int, context long, key long, base double>>"), "places")
    met = places.select("id", F.explode("deep").alias("d")).select("id", "d.*").join(totals, ["allow", "context"]).join(model, ["allow", "key"], "left")
    # a context that was seen has all shorter ones before it
    ordered = met.groupBy("id", "at", "allow").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds"))).alias("l"))
    p = F.aggregate("l", F.col("base"), lambda p, x: (x["n"] + x["kinds"] * p) / (x["total"] + x["kinds"]))
    more = F.ln(p) - F.ln("base")
    added = ordered.groupBy("id").agg(F.sum(F.when(F.col("allow"), more).otherwise(-more)).alias("more")).withColumnRenamed("id", "more_id")
    summed = places.select(F.col("id").alias("sum_id"), "s", "size").join(added, F.col("sum_id") == F.col("more_id"), "left")
    by = distinct.join(summed, F.col("id") == F.col("sum_id")).select(F.col("u").alias("_key"), ((F.col("s") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("score"))
    return rows.join(by, F.coalesce(F.col(url), F.lit("")) == F.col("_key")).drop("_key")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled: DataFrame | None = None, broadcast_rows: int = MODEL_ROWS) -> DataFrame:
    """(id, host, path, rule, score, verdict) of every row.

    A rule that fits decides. Other URLs are judged by the models, learned from ``labelled`` (url, verdict), or by default
    from the URLs that rules decide; where one verdict has no URLs, a model knows nothing and all its chances are uniform. A null
    URL counts as empty; repeated rows come out as often as they come in.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    known = (labelled if labelled is not None else rows.where("rule is not null")).where("url is not null and verdict in ('allow', 'block')")
    known = written(known.select("url", (F.col("verdict") == "allow").alias("allow")).distinct(), "labelled")
    fifth = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = counts(known.where(~fifth))
    # scores in steps, so few rows reach the driver however many URLs there are
    steps = scored(known.where(fifth), model, broadcast_rows=broadcast_rows).groupBy(F.round(F.col("score") / STEP).cast("long").alias("step")).agg(F.count_if("allow").alias("a"), F.count_if(~F.col("allow")).alias("b"))
    threshold = calibrated([(r["step"] * STEP, r["a"], r["b"]) for r in steps.collect()])
    rows = scored(rows, model, broadcast_rows=broadcast_rows)
    by_model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", "score", F.coalesce("verdict", by_model).alias("verdict"))
