"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, langid, licenses, mixing, packing, repetition, secret_scan, simhash, suffix, warc
from .common import documents


def tokenizer_files(json_name: str = "byte_bpe_50k.json", ranks_name: str = "byte_bpe_50k.tiktoken") -> dict[str, str]:
    """Where the public vocabulary lies on this machine; executors have it at the same place."""
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path(json_name),
        "ranks_path": public_tokenizers.path(ranks_name),
        "pattern": public_tokenizers.PATTERN,
    }


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    made = warc.derive(warc.responses(pages), "page_id")
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type",
        F.element_at("headers", "WARC-Source-Block-Digest").alias("source_block_digest"),
        F.element_at("headers", "WARC-Source-Payload-Digest").alias("source_payload_digest"),
        F.element_at("headers", "WARC-Block-Digest").alias("block_digest"),
        F.length("block").cast("long").alias("content_length"),
        F.col("block").cast("string").alias("content"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(documents(spark, sf_dir), **tokenizer_files(), capacity=1024, end_id=2)
    return packing.pack(pieces, capacity=1024)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, threshold=3, seed=42)


def op4_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def language_model(spark: SparkSession, docs: DataFrame) -> langid.Model:
    """Learned from text and language of the documents outside the held-out fold."""
    return langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, language_model(spark, docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, sf_dir)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), least=200)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.0, max_epochs=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_suffix_repetition": op4_suffix_repetition,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {
    "op6_exact_dedup": exact.SQL,
    "op8_license_scan": licenses.oracle(),
    "op10_mixing": mixing.SQL,
}
