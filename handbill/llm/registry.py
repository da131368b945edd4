"""The corpus queries, opN_<name>, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language_id, mixing, mpeg_audio, packing, pii, secrets_scan, simhash, term_topk, token_counts, vector_codes, word_runs


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", *(F.col(f"_mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens", "rate", "copies")))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.read(mpeg_audio.store(documents(spark, sf_dir)))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.digest(secrets_scan.scan(documents(spark, sf_dir)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 2048 ids, each document ended by the vocabulary's free id."""
    docs, path = documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return packing.pack(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), end_id=50256, pad_id=50256, about_tokens=n_bytes // 3, positioned=False, replayed=True).drop("position_ids")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.with_label_errors(vector_codes.coded(embeddings(spark, sf_dir)))


def op12_term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50."""
    return term_topk.top(embeddings(spark, sf_dir), F.col("id") % 50 == 0)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.digest(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_exact_dedup, op3_mpeg_audio, op4_byte_bpe, op5_secrets, op6_simhash, op7_token_counts, op8_language_id, op9_personal_data, op10_packing, op11_vector_codes, op12_term_topk, op13_word_runs)
    return {f.__name__: f for f in found}


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(content) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY content)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.mix_sql(mixing.Plan()), "op2_exact_dedup": OP2_SQL, "op11_vector_codes": vector_codes.codes_sql(), "op12_term_topk": term_topk.TOP_SQL}
