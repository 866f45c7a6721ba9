"""The corpus pipeline: stages applied one after the other, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import exact, packing, quality, simhash
from tideline.llm.queries import BYTE_BPE, END
from tideline.llm.shared import table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts count as empty; an empty table stays empty; all columns stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles show as 0.8 alike or more, directly or in steps, the one with the smallest id stays."""
    return simhash.drop_near(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1,024 tokens: one row a piece."""
    return packing.pack(packing.pieces(docs, BYTE_BPE, END, 1024), 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("best_fit_packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: The stages learn, hash by word n-grams and pack by search: SQL can't express them; tests hold them against brute force.
ORACLE_SQL = None
