"""The bitemporal store of articles, scores, feed runs and run log: append-only tables under one folder."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import text
from tideline.operators import dedup, merge
from tideline.operators.news import EVENT_TYPES
from tideline.plans.switch import Switch
from tideline.sources import readers, sinks

ARTICLES = "url_hash string, revision_no int, source string, tier int, url string, title string, body string, body_hash string, published_at_utc timestamp_ntz, first_seen_at_utc timestamp_ntz, backfilled boolean"
SCORES = "url_hash string, revision_no int, scored_at_utc timestamp_ntz, model string, assets string, sentiment double, confidence double, event_type string, severity int, is_price_report boolean, duplicate_of string"
RUNS = "feed_name string, at timestamp_ntz, etag string, modified string, error string"
LOG = "run_at_utc timestamp_ntz, feeds_ok int, feeds_failed int, new_articles int, revisions int, duration_s double"
#: Likeness from which a pending article is a copy of a recent one, and how many recent ones are compared.
LIKE, RECENT = 0.87, 300
#: A scorer takes (title, body) and gives the JSON text of a score; an embedder takes texts and gives vectors.
Scorer = Callable[[str, str], str]
Embedder = Callable[[list[str]], list[list[float]]]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """articles, scores, runs or log; empty where nothing was written yet."""
        schema = {"articles": ARTICLES, "scores": SCORES, "runs": RUNS, "log": LOG}[name]
        if sinks.exists(self.spark, self._path(name)):
            return self.spark.read.schema(schema).parquet(self._path(name))
        return self.spark.createDataFrame([], schema)

    def upsert(self, sightings: DataFrame) -> dict[str, int]:
        """Appends sightings (source, tier, url, title, body, published_at_utc, first_seen_at_utc, backfilled) whose content is new; counts by status.

        The first sighting of a content stays; a changed one is a revision with a sighting time of its own.
        """
        rows = sightings.withColumns({"url_hash": F.sha2("url", 256), "body_hash": merge.content_hash(F.col("title"), F.col("body"))})
        held = self.table("articles").select("url_hash", "body_hash", "revision_no")
        total = rows.count()
        fresh = merge.append_revisions(held, rows, "url_hash", "body_hash", ["first_seen_at_utc", "body_hash"]).cache()
        try:
            counts = {r["status"]: r["count"] for r in fresh.groupBy("status").count().collect()}
            names = [f.name for f in self.table("articles").schema.fields]
            fresh.select(*[F.col(f.name).cast(f.dataType) for f in self.table("articles").schema.fields]).select(*names).write.mode("append").parquet(self._path("articles"))
        finally:
            fresh.unpersist()
        return {"new": counts.get("new", 0), "revision": counts.get("revision", 0), "unchanged": total - sum(counts.values())}

    def log_feeds(self, runs: DataFrame) -> None:
        runs.select(*[F.col(f.name).cast(f.dataType) for f in self.table("runs").schema.fields]).write.mode("append").parquet(self._path("runs"))

    def feed_state(self) -> DataFrame:
        return merge.feed_state(self.table("runs"))

    def log_run(self, feeds_ok: int, feeds_failed: int, new: int, revisions: int, duration: float) -> None:
        row = self.spark.createDataFrame([(feeds_ok, feeds_failed, new, revisions, float(duration))], "feeds_ok int, feeds_failed int, new_articles int, revisions int, duration_s double")
        row.select(F.current_timestamp().cast("timestamp_ntz").alias("run_at_utc"), "*").write.mode("append").parquet(self._path("log"))

    def collect(self, feeds: DataFrame, seen_at: str = "first_seen_at_utc") -> dict[str, int]:
        """One round over fetched feeds (feed_name, tier, xml, error, etag, modified, first_seen_at_utc): entries to articles, runs to feed state, a line to the log."""
        entries = readers.feed_entries(feeds.where("error is null and xml is not null"), "xml", ["feed_name", "tier", seen_at])
        rows = entries.select(F.col("feed_name").alias("source"), "tier", "url", "title", "body", F.col("published_at_utc").cast("timestamp_ntz").alias("published_at_utc"), F.col(seen_at).cast("timestamp_ntz").alias("first_seen_at_utc"), F.lit(False).alias("backfilled"))
        counts = self.upsert(rows)
        self.log_feeds(feeds.select("feed_name", F.col(seen_at).alias("at"), "etag", "modified", "error"))
        n = feeds.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
        self.log_run(n["ok"], n["bad"], counts["new"], counts["revision"], 0.0)
        return counts

    def pending(self, limit: int = 500) -> DataFrame:
        """Articles without a score, those seen first before others."""
        left = merge.not_in(self.table("articles"), self.table("scores"), ["url_hash", "revision_no"])
        return left.orderBy("first_seen_at_utc", "url_hash", "revision_no").limit(limit)

    def recent(self, n: int = RECENT) -> DataFrame:
        """The newest articles that have a score of their own: neither copies nor failures."""
        scored = self.table("scores").where("duplicate_of is null and model not in ('failed', 'dedup')").select("url_hash", "revision_no")
        return self.table("articles").join(scored, ["url_hash", "revision_no"]).orderBy(F.desc("first_seen_at_utc"), "url_hash").limit(n)

    def score_pending(self, scorer: Scorer, embedder: Embedder, switch: Switch, model: str = "model", limit: int = 500, tries: int = 3) -> dict[str, int]:
        """Near-copies of recent articles are marked so; others are scored on the executors; what can't be scored is kept as failed, so that it doesn't come up again."""
        switch.ensure("scoring articles")
        lede = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 500))

        def embed(frames):
            for pdf in frames:
                yield pdf.drop(columns="lede").assign(vector=embedder(pdf["lede"].tolist()))

        def vectors(df: DataFrame) -> DataFrame:
            plain = df.select(F.concat_ws(":", "url_hash", "revision_no").alias("key"), "url_hash", "revision_no", F.col("first_seen_at_utc").alias("seen_at"), lede.alias("lede"))
            return plain.mapInPandas(embed, "key string, url_hash string, revision_no int, seen_at timestamp_ntz, vector array<double>")

        def score(frames):
            for pdf in frames:
                out = []
                for title, body in zip(pdf["title"], pdf["body"], strict=True):
                    got = None
                    for _ in range(tries):
                        try:
                            got = scorer(title or "", body or "")
                            break
                        except Exception:  # any failure of the service counts as a failed try
                            continue
                    out.append(got)
                yield pd.DataFrame({"url_hash": pdf["url_hash"], "revision_no": pdf["revision_no"], "payload": out})

        todo = self.pending(limit).cache()
        try:
            marked = dedup.greedy_cosine(vectors(todo), vectors(self.recent()), LIKE).cache()
            keys = todo.select(F.concat_ws(":", "url_hash", "revision_no").alias("key"), "url_hash", "revision_no", "title", "body", "backfilled")
            joined = keys.join(marked, "key")
            fresh = joined.where("duplicate_of is null")
            hidden = F.when(F.col("backfilled"), text.anonymise(F.coalesce("body", F.lit("")))["text"]).otherwise(F.col("body"))
            got = fresh.select("url_hash", "revision_no", "title", hidden.alias("body")).mapInPandas(score, "url_hash string, revision_no int, payload string")
            s = readers.scores(F.col("payload"), EVENT_TYPES)
            got = got.withColumn("s", s)
            now = F.current_timestamp().cast("timestamp_ntz").alias("scored_at_utc")
            scored = got.select(
                "url_hash", "revision_no", now, F.when(F.col("s").isNull(), "failed").otherwise(model).alias("model"), F.array_join("s.assets", ",").alias("assets"), "s.sentiment", "s.confidence",
                "s.event_type", "s.severity", "s.is_price_report", F.lit(None).cast("string").alias("duplicate_of"),
            )
            copies = joined.where("duplicate_of is not null").select("url_hash", "revision_no", now, F.lit("dedup").alias("model"), F.split("duplicate_of", ":")[0].alias("duplicate_of"))
            rows = scored.unionByName(copies, allowMissingColumns=True).cache()
            counts = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
            sinks.insert_or_ignore(rows, self._path("scores"), ["url_hash", "revision_no"])
            rows.unpersist()
            marked.unpersist()
        finally:
            todo.unpersist()
        return {"scored": counts.get(model, 0), "duplicates": counts.get("dedup", 0), "failed": counts.get("failed", 0)}

    def stats(self) -> dict:
        """Articles in all and backfilled, the last run, articles by source, and feeds with three errors or more."""
        first = self.table("articles").where("revision_no = 0")
        total = first.agg(F.count("*").alias("n"), F.count_if("backfilled").alias("b")).first()
        last = self.table("log").orderBy(F.desc("run_at_utc")).limit(1).collect()
        return {
            "articles_total": total["n"], "articles_backfilled": total["b"], "last_run": last[0].asDict() if last else None,
            "by_source": [tuple(r) for r in first.groupBy("source").count().orderBy(F.desc("count"), "source").collect()],
            "unhealthy_feeds": [tuple(r) for r in self.feed_state().where("error_count >= 3").select("feed_name", "error_count", "last_error").orderBy(F.desc("error_count")).collect()],
        }


def latest(scores: DataFrame) -> DataFrame:
    """The last row of each key of a table that was appended to more than once."""
    w = Window.partitionBy("url_hash", "revision_no").orderBy(F.desc("scored_at_utc"))
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
