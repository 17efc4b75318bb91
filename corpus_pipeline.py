"""Cleaning a corpus for training, as a chain of stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written and read again.
All but the last return the columns of the documents; the last returns the packed layout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthspark.llm import decontaminate, language_codes, line_chunks, near_copies, packing, reach_workers
from synthspark.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is decoded without doubt; their ``lang`` stays as it was."""
    reach_workers(spark)
    found = language_codes.identify(docs, language_codes.document_model(docs), prefix="__language_")
    kept = found.where((F.col("__language_lang_pred") != language_codes.UNKNOWN) & ~F.col("__language_ambiguous"))
    return kept.drop("__language_lang_pred", "__language_score", "__language_ambiguous")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated chunks of lines out of the texts; a document that loses all its words goes.

    ``n_chars`` follows the text if there is such a column.
    """
    cleaned = line_chunks.dedup_line_chunks(docs, prefix="__lines_")
    changed = F.col("__lines_removed_chunks") > 0
    cleaned = cleaned.where(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length)
    return cleaned.select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies (Jaccard similarity of five-word shingles from 0.8)."""
    reach_workers(spark)
    return near_copies.keep_one(docs, width=5)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents' token ids out in sequences of 4,096."""
    reach_workers(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", without_benchmark_items),
    ("pack", packed),
]

# Trained scorers and tokenizers are beyond SQL; the tests hold the chain against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed layout of what is left of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
