"""What several operators need: tables written in the shared folder, and reading rows in slices."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_dir


#: The folder of tables within the shared one.
_folder: ContextVar[str] = ContextVar("folder", default="")


@contextmanager
def scratch(spark: SparkSession):
    """Tables written within stand in one folder of the shared one, which goes at the end. Results read them lazily: write those before.

    with scratch(spark): corpus_pipeline.run(spark, folder).write.parquet(out)
    """
    name = f"/run-{uuid.uuid4().hex}"
    token = _folder.set(name)
    try:
        yield
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark) + name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and a lost executor costs only a new read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}{_folder.get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_key(name: str):
    """The column as an expression of its own, so that a join on it gets an exchange that AQE can split."""
    return F.expr(f"{name} + 0L")


#: Keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def matched(rows: DataFrame, keys: DataFrame, on: list, how: str) -> DataFrame:
    """rows (how: left_semi) whose expressions ``on`` equal (nulls too) the columns of one of the keys, which are of fixed width; or (left_anti) the others.

    An expression may be a function of the key's column that says whether they fit.

    The keys' number is checked: few are broadcast, so rows aren't shuffled. Key columns get names of their own, so no column of rows clashes.
    """
    names = [f"k{i}_{uuid.uuid4().hex}" for i in range(len(keys.columns))]
    keys = written(keys.toDF(*names), "keys")
    meets = None
    for x, n in zip(on, names, strict=True):
        one = x(F.col(n)) if callable(x) else x.eqNullSafe(F.col(n))
        meets = one if meets is None else meets & one
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, meets, how)


def without(rows: DataFrame, keys: DataFrame, on: list) -> DataFrame:
    return matched(rows, keys, on, "left_anti")


def slices(values: list, weight: int):
    """Runs of values whose lengths add up to about weight, in order."""
    run, size = [], 0
    for x in values:
        run.append(x)
        size += len(x or "")
        if size >= weight:
            yield run
            run, size = [], 0
    if run:
        yield run
