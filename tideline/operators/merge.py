"""Merging tables: keep first or last by source, revisions, state rows, and rows not seen yet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: str = "last", tie: Sequence[Column] = ()) -> DataFrame:
    """old and new by name, one row a key: keep="last" takes the new one, "first" the old one. Columns that one lacks are null."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_from").desc() if keep == "last" else F.col("_from").asc(), *tie]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n", "_from")


def not_in(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't known yet: INSERT OR IGNORE, or work still to be done."""
    return rows.join(known.select(*keys).distinct(), [*keys], "left_anti")


def content_hash(*columns: Column) -> Column:
    """sha256 of columns (null: empty) joined by newlines."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns]), 256)


def revisions(sightings: DataFrame, key: str, content: str, order: Sequence[str]) -> DataFrame:
    """Sightings that change a key's content from the one before: adds revision_no from 0, and status new or revision.

    Only the latest content counts, so A, B, A are three revisions.
    """
    w = Window.partitionBy(key).orderBy(*order)
    seen = sightings.withColumns({"_before": F.lag(content).over(w), "_first": F.row_number().over(w) == 1})
    kept = seen.where(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(content)))
    kept = kept.withColumn("revision_no", F.row_number().over(w) - 1)
    return kept.withColumn("status", F.when(F.col("revision_no") == 0, "new").otherwise("revision")).drop("_before", "_first")


def append_revisions(held: DataFrame, sightings: DataFrame, key: str, content: str, order: Sequence[str]) -> DataFrame:
    """New rows to append to a table with revision_no: sightings are compared with the latest revision held of their key."""
    newest = held.groupBy(key).agg(F.max_by(F.struct(content, "revision_no"), "revision_no").alias("_h"))
    got = sightings.join(newest, key, "left")
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag(content).over(w), F.col("_h")[content])
    kept = got.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(content)))
    number = F.row_number().over(w) + F.coalesce(F.col("_h")["revision_no"], F.lit(-1))
    return kept.withColumn("revision_no", number.cast("int")).withColumn("status", F.when(F.col("revision_no") == 0, "new").otherwise("revision")).drop("_h", "_before")


def feed_state(runs: DataFrame, key: str = "feed_name", at: str = "at") -> DataFrame:
    """State by feed of runs (key, at, etag, modified, error): what the last success left, and errors since it."""
    ok = F.col("error").isNull()
    last_ok = F.max(F.when(ok, F.col(at))).over(Window.partitionBy(key))
    rows = runs.withColumn("_ok", last_ok)
    since = F.col("_ok").isNull() | (F.col(at) > F.col("_ok"))
    out = rows.groupBy(key).agg(
        F.max_by(F.struct("etag", "modified"), F.when(ok, F.col(at))).alias("s"), F.max("_ok").alias("last_ok"),
        F.max_by(F.substring("error", 1, 500), F.when(~ok & since, F.col(at))).alias("last_error"), F.count_if(~ok & since).alias("error_count"),
    )
    return out.select(key, "s.etag", "s.modified", "last_ok", "last_error", "error_count")
