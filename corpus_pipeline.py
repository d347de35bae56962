"""A corpus through five stages: quality classifier, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``, whatever these are. Results are written as Parquet between stages.

Defined results: rows without an id pass unread until the last stage, which packs rows with an id only; an empty table
gives an empty result at each stage; columns with names that the operators use themselves come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.line_dedup import repeated_lines, without_lines
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.quality_lm import classify
from tidemark.llm.shared import reclaim, stage, without_ids

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold. Null and empty texts go; of rows with one id all go
    if one does; without trusted labels all other texts stay."""
    reclaim(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rejected = classify(docs, labels).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return without_ids(docs, stage(rejected, "rejected"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars follows the text. A null text stays null, one that has lost
    all its lines is empty, and exactly repeated rows are one document and stay alike."""
    reclaim(spark)
    return without_lines(docs, repeated_lines(docs, short=True), length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates (five-word shingles, 0.8 or more). Texts without
    words stay; rows with the id that stays all do."""
    reclaim(spark)
    copies = near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    return without_ids(docs, stage(copies, "copies"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts stay; a null or empty item is held by none."""
    reclaim(spark)
    leaks = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return without_ids(docs, leaks)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens. A null text is empty: one piece, the end id."""
    reclaim(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER), cached=200_000)  # workers still hold what earlier stages loaded


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Perplexities, edit distances, the latent space and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
        reclaim(spark)
    return docs
