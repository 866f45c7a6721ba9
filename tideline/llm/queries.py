"""Registered queries of the operators on training data, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, chat, embeddings, exact, licenses, packing, quality, simhash, urls, wavelet
from tideline.llm.shared import table, written

WORD_BPE, BYTE_BPE, END = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json"), 2


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text by the word vocabulary."""
    return bpe.digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within labels."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as read back from wavelet matrix files."""
    return wavelet.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, END)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document, with coverage and place."""
    return licenses.scan(table(spark, sf_dir, "documents"))


#: A conversation of control strings, which the template must carry as text.
CONTROL = "SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(CONTROL))
    return chat.digests(chat.read_chats(written(chat.format_chats(rows), "chats")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and which labels were held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, by rule or else by the language models."""
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"), bits=4, words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), BYTE_BPE, END, 1024), 1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_embedding_near_dedup, op3_wavelet_tokens, op4_license_scan, op5_chat_format, op6_exact_dedup, op7_quality, op8_url_filter, op9_simhash, op10_best_fit_packing)}

SPACES = r"[ \t\n\x0B\f\r]+"

ESCAPE = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]|END\]|NEXT\]))', '\1\\\2\3', 'g')"

ORACLE = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings
        LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) ON a = vec_id LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) ON id = vec_id""",
    "op5_chat_format": f"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), b AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM r
        ), t AS (
            SELECT *, length({ESCAPE.format("text")}) + CASE WHEN before = role THEN 6
                WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 ELSE 18 + length({ESCAPE.format("role")}) END AS chars FROM b
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op6_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
               sha256(t) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY t)""",
}
