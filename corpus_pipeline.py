"""A training-data pipeline over ``documents``: five stages, each a table that the next one reads."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from densegraph.llm import common, decontaminate, near_dup, quality_rules, secrets, spm


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep.

    Figures are worked out once and written beside the rows. Null and empty texts go, as they fail the base rules; rows with null ids are judged like
    others; repeated rows stay or go together; an empty table gives none.
    """
    figures = common.save(quality_rules.statistics(docs))
    return figures.where(quality_rules.verdict(figures)[1]).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id.

    Rows with null ids and null or empty texts are linked with nothing and stay, as do repeated rows of an id that stays; an empty table gives none.
    """
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id")
    return common.chosen(docs, gone, "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Rows with null ids and null or empty texts stay; an empty benchmark lets all stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and ``n_chars`` renewed.

    Spans are worked out once and written beside the rows. Null texts stay null with the n_chars that they have; every row stays.
    """
    clean = secrets.redact(docs, found=common.save(secrets.with_spans(docs, "text")))
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", size).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece identifiers of every document, decoded again as a check. Null and empty texts have none; every row stays."""
    return spm.encode_decode(docs, model=public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("sentencepiece", token_stage),
]

#: The stages can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.save(stage(spark, docs, sf_dir))
    return docs
