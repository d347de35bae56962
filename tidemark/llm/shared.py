"""Small helpers for plans."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import maybe_in, shared_dir, stage, sweep, trim  # noqa: F401
from .hashing import give_back


def reclaim(spark: SparkSession) -> None:
    """Let the JVM collect finished plans, so that the context cleaner removes the shuffle files of steps
    whose results are already in a written table, and delete the tables that no plan reads any more. Changes no result;
    bounds the disk that a chain of steps holds."""
    gc.collect()  # plans that Python still holds in cycles
    spark.sparkContext._jvm.System.gc()
    sweep(spark)
    trim(spark)
    give_back()


def parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for packed exchanges: follows the session's setting for shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, under fixed names; other columns, whatever their names, are not touched.
    A row without an id cannot be reported and is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in more]).where(F.col("doc_id").isNotNull())


def whole_row(df: DataFrame) -> Column:
    """All columns as one, so that no name of theirs clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of a packed row again, some of them changed."""
    return df.select(*[changed.get(c, F.col(row).getField(c)).alias(c) for c in columns])


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs, all columns, without the rows whose id is in ids.doc_id. Only rows that may be affected are joined, so the
    other texts are not shuffled. Rows without an id stay."""
    keyed = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    marked = maybe_in(ids, "doc_id")(keyed, "id", "some")
    gone = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
    some = marked.where("some").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return unpacked(some.unionByName(marked.where("not some")), "row", docs.columns)
