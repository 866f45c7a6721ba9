"""As-of joins: for each left row the newest right row at or before it, by union and a last() window over one sort.

The right row travels as a struct, so a newest row with null fields still wins. With ``bucket`` seconds the window runs within time
buckets, and what a bucket starts with comes from a table of bucket ends: a key that holds most rows then spreads over
as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), bucket: int | None = None, matched: str = "matched", tie: str | None = None) -> DataFrame:
    """left with ``matched``, a struct of the right row (all its columns but the keys), or null.

    A match has the greatest right time not after the left time; of equal times the one with the greatest ``tie``. Left rows with a null
    time match nothing; right rows with a null time never match.
    """
    names = [c for c in right.columns if c not in by]
    key = [F.col(b) for b in by]
    values = F.struct(*names)
    r = right.where(F.col(right_on).isNotNull()).select(*key, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None)).cast("string" if not tie else right.schema[tie].dataType).alias("_tie"), values.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"))
    ltype = r.schema["_tie"].dataType
    rows = left.select(*key, F.col(left_on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(ltype).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = r.unionByName(rows)
    order = ["_t", "_side", F.col("_tie").asc_nulls_first()]
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn(matched, F.last("_r", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_b", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / F.lit(bucket * 1_000_000)).cast("long"))
        w = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w))
        # one row a bucket: the last right row, carried over buckets that have none
        ends = both.groupBy(*by, "_b").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_e"))
        carried = F.last("_e", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        starts = ends.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_b").alias("_kb"), carried.alias("_start"))
        meets = F.col("_b").eqNullSafe(F.col("_kb"))
        for b in by:
            meets &= F.col(b).eqNullSafe(F.col(f"_k_{b}"))
        found = found.join(starts, meets).withColumn(matched, F.coalesce("_in", "_start"))
    found = found.where("_side = 1").withColumn(matched, F.when(F.col("_t").isNotNull(), F.col(matched)))
    return found.select("_l.*", matched)


def age_hours(later: Column, earlier: Column) -> Column:
    """Whole minutes between, as hours."""
    return F.timestamp_diff("MINUTE", earlier, later) / F.lit(60.0)


def asof_published(spine: DataFrame, source: DataFrame, values: Sequence[str], prefix: str, cap_hours: float, by: Sequence[str] = (), published: str = "published_at", decision: str = "decision_day", bucket: int | None = None) -> DataFrame:
    """Adds ``{prefix}_{value}`` of the newest published row and its age ``{prefix}_age_h``; values older than the cap are null, the age is not."""
    found = asof_backward(spine, source.select(*by, published, *values), decision, published, by, bucket)
    age = age_hours(F.col(decision), F.col("matched")[published])
    out = found.withColumn(f"{prefix}_age_h", age)
    kept = {f"{prefix}_{v}": F.when(~F.coalesce(F.col(f"{prefix}_age_h") > cap_hours, F.lit(False)), F.col("matched")[v]) for v in values}
    return out.withColumns(kept).drop("matched")
