"""Writers: replace by swap, merges, vintages, quarantine, JSON."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.merge import merge, not_in


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes beside ``path`` and swaps, so that df may read ``path`` itself and readers never see half a table."""
    spark = df.sparkSession
    side = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*partition_by).parquet(side) if partition_by else df.write.parquet(side)
    fs, target = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(_fs(spark, side)[1], target):
        if had:
            fs.rename(old, target)
        raise OSError(f"could not move {side} to {path}")
    if had:
        fs.delete(old, True)


def load_or_quarantine(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is none; one that can't be read is renamed with .corrupt- and a stamp, never deleted."""
    if not exists(spark, path):
        return None
    try:
        df = spark.read.parquet(path)
        df.head(1)
        return df
    except Exception:
        fs, p = _fs(spark, path)
        stamp = spark.sql("select date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
        fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.corrupt-{stamp}"))
        return None


def merge_write(new: DataFrame, path: str, keys: Sequence[str], keep: str = "last") -> None:
    """Merges into the table at ``path``: one row a key, the new one with keep="last", the old one with "first"."""
    old = load_or_quarantine(new.sparkSession, path)
    replace(new if old is None else merge(old, new, keys, keep), path)


def append_vintage(df: DataFrame, path: str, at: str = "snapped_at_utc") -> None:
    """Appends a snapshot under its time; nothing older is touched."""
    df.withColumn(at, F.current_timestamp()).write.mode("append").parquet(path)


def insert_or_ignore(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends rows whose key isn't there; of equal keys in df one stays."""
    fresh = df.dropDuplicates(list(keys))
    if exists(df.sparkSession, path):
        fresh = not_in(fresh, df.sparkSession.read.parquet(path), keys)
    fresh.write.mode("append").parquet(path)


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replaces only the days that df holds; a day is written whole or not at all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def pending_days(spark: SparkSession, first: str, last: str, done: DataFrame, day: str = "day") -> DataFrame:
    """Calendar days without rows."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}', interval 1 day)) as {day}")
    return not_in(days, done.select(F.col(day).cast("date").alias(day)), [day])


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def artefact(df: DataFrame, key: str | None = None, most: int = 10_000) -> str:
    """A small result as one JSON text: an array of rows, or an object by ``key``. Raises above ``most`` rows; larger ones are for write_json()."""
    rows = df.limit(most + 1).select(F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("j"), (F.col(key).cast("string") if key else F.lit("")).alias("k")).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one text")
    if key:
        return "{" + ",".join(f'"{k}":{j}' for k, j in sorted((r["k"], r["j"]) for r in rows)) + "}"
    return "[" + ",".join(r["j"] for r in rows) + "]"
