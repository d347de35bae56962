"""Sinks: receipts, exports, reports. Writers rely on Spark's commit protocol: a result is there as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import prune_newest


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    out = rows.write.mode("append")
    (out.partitionBy(partition) if partition else out).parquet(path)


def pruned_receipts(spark: SparkSession, path: str, as_of: Column, most: int = 1000, days: int = 7) -> DataFrame:
    return prune_newest(spark.read.parquet(path), "time", "request_id", most, as_of, days)


def newest_receipts(receipts: DataFrame, most: int = 100) -> DataFrame:
    """The newest receipts with their ids decoded; a missing list is empty."""
    ids = F.coalesce(F.from_json("ids", "array<string>"), F.array().cast("array<string>"))
    return receipts.withColumn("ids", ids).orderBy(F.desc("time"), "request_id").limit(most)


def export(dashboard: dict[str, DataFrame], consent: bool, folder: str) -> None:
    """Write a dashboard's tables as JSON; without consent nothing is written."""
    if not consent:
        raise PermissionError("export needs consent")
    for name, df in dashboard.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}")


def report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").json(path)
