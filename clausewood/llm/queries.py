"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewood.llm import chat, decontamination, exact_dedup, langid, license_scan, ngram_join, piece_sampling, quality, sharding, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every link is found; the query's SQL has no column for their number.
    return ngram_join.join_links(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], rows.schema)
    return chat.digest(chat.render(chat.reconstruct(chat.conversation_events(rows.unionByName(probe)))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_token_counts, op3_ngram_jaccard_join, op4_sentencepiece_sampling, op5_quality_classifier, op6_chat_formatting, op7_language_id, op8_benchmark_decontamination, op9_exact_dedup, op10_license_scans)}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "op3_ngram_jaccard_join": ngram_join.oracle(), "op6_chat_formatting": chat.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op10_license_scans": license_scan.oracle()}
