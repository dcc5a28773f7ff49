"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, linedup, lm, minhash, packing, quality, secrets_scan, shared, sql, sstable, token_count


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(shared.documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.by_document(shared.documents(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(shared.documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(shared.documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.documents(spark, sf_dir), packing.Params(vocabulary_file("word_bpe_49k.json")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(shared.documents(spark, sf_dir), token_count.Params(vocabulary_file("byte_bpe_50k.json")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(shared.documents(spark, sf_dir))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(shared.documents(spark, sf_dir), sstable.Params(vocabulary_file("byte_bpe_50k.json")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(shared.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = (op1_minhash, op2_quality, op3_line_dedup, op4_language_model, op5_licenses, op6_packing, op7_token_counts, op8_secrets, op9_sstable, op10_decontamination)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
