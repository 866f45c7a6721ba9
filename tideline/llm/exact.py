"""Exact dedup by progressive refinement: group by length, then by prefix hash, then by full hash.

DataFrame functions only. Every text is normalised where it is read; only its length and the hash of its first characters
are shuffled. Lengths that one row has are settled there, then pairs of length and prefix hash; only rows that are left
have their content read for the full hash. Counts are summed before they are shuffled, and the last join is of the kind that AQE
splits, so a text that holds a third of all rows spreads out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import matched, without, written

#: Characters whose hash refines a group of equal lengths.
PREFIX = 128


def normalised(text: Column) -> Column:
    """The text (null: empty) with each run of ASCII white space as one space. Single spaces aren't touched, so they cost nothing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def signatures(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    text = normalised(F.col(text_col))
    first = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    sig = [F.col("id"), F.char_length("t").alias("len"), F.xxhash64(F.substring("t", 1, PREFIX)).alias("prefix")]
    return first.select(*sig, *([F.sha2("t", 256).alias("full")] if digest else []))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, len, prefix, text_sha256 or full) for every row; full is null where no full hash was needed.

    Null texts count as empty. Of equal texts the row with the smallest id stays (nulls last; of rows that share
    the smallest id each is marked kept, as they can't be told apart); keep_id is null only if all ids of a group are.
    With digest=True every row carries its full hash from the first reading, which then serves the last step as well;
    else the content of surviving rows is read again. Extra columns are ignored; an empty table gives an empty one.
    """
    sig = written(signatures(docs, id_col, text_col, digest), "signatures")
    # lengths are at most as many as the longest text has characters, so the first filter is always a broadcast in practice
    by_len = sig.groupBy("len").count().where("count > 1").select("len")
    by_prefix = matched(sig, by_len, [F.col("len")], "left_semi").groupBy("len", "prefix").count().where("count > 1")
    alive, on = written(by_prefix.select("len", "prefix"), "alive"), [F.col("len"), F.col("prefix")]
    left = matched(sig if digest else signatures(docs, id_col, text_col, True), alive, on, "left_semi")
    if not digest:
        left = written(left, "left")
    groups = left.groupBy("full").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups").select(F.concat("full", F.lit("")).alias("k_full"), "keep_id", "group_size")
    if digest:
        out = sig.join(groups, F.col("full") == F.col("k_full"), "left")
    else:
        alone = matched(sig, alive, on, "left_anti")
        out = left.join(groups, F.col("full") == F.col("k_full"), "left").select("id", "len", "prefix", "full", "keep_id", "group_size")
        out = out.unionByName(alone, allowMissingColumns=True)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    kept = F.coalesce(F.col("id") == keep, keep.isNull())
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "len", "prefix", F.col("full").alias("text_sha256" if digest else "full"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() doesn't keep; columns and rows that stay are as they were.

    A row goes by its id and the full hash of its text together, so other texts under the same id stay.
    """
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(id_col, "len", "prefix", "full")
    text = f"t_{uuid.uuid4().hex}"  # normalised once, under a name that no column has
    held = docs.withColumn(text, normalised(F.col(text_col)))
    # the full hash is made only of rows that the other keys fit: what isn't an equality is no key of the join
    same = lambda full: F.nullif(F.sha2(text, 256), full).isNull()
    return without(held, gone, [F.col(id_col), F.char_length(text), F.xxhash64(F.substring(text, 1, PREFIX)), same]).drop(text)
