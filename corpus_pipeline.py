"""From raw documents to encoded training text: five stages, each one of the numbered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, near_dups, pieces, quality, secrets
from quarry.llm.common import drop_scratch, materialize, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the weak-supervision model keep."""
    return quality.keep_good(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return near_dups.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with reported secrets masked and n_chars made to fit."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes and lossless of each document of the mix; copies of one get pieces of their own."""
    return pieces.encode(docs, "piece_bpe_32k.model", copies=True)


STAGES = [("quality", quality_stage), ("near_dups", near_dup_stage), ("secrets", secret_stage), ("mixing", mixing_stage), ("pieces", piece_stage)]

#: The model, MinHash and the piece encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread; scratch tables go as soon as nothing reads them.

    Null and empty texts have no words and fail the base rule of quality; a null key or source is
    one like others; repeated rows are near copies of one another, of which one stays; an empty
    table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = len(written)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_scratch(spark, written[begin:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
