"""The corpus pipeline: reject, deduplicate, thin out near copies, decontaminate, encode.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; each is written as Parquet and read again before the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausewood.llm import decontamination, exact_dedup, ngram_join, piece_sampling, quality
from clausewood.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the one with the least id stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, with the piece ids."""
    import public_tokenizers

    return piece_sampling.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode_samples),
]

#: SQL can't express the classifier or the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
