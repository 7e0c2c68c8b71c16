"""A corpus made ready for training: five stages, each over all that the one before it kept.

Every stage's result is written as Parquet in the shared folder and read again for the next. All but
the last return the columns of the documents; the last returns token ids instead of text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, jaccard_dedup, line_dedup, quality_rules
from quern.storage import materialize


def _as_documents(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted anew."""
    return made.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else made.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their common lines."""
    return _as_documents(line_dedup.dedup_lines(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 at least."""
    return jaccard_dedup.drop_near_duplicates(docs, width=5, similarity=0.8)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Token ids of each document, and the digests of ids and of what they decode to."""
    import public_tokenizers

    made = bpe.round_trip(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)
    return made.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_copies),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


#: Fingerprints, retrieval and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None
