"""Registry, and the derived tables that several queries use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(column: str) -> Column:
    """A zoneless time as an instant of UTC."""
    return F.to_timestamp(F.concat(F.date_format(F.col(column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))


def as_of(text: str = "2024-01-31T00:00:00Z") -> Column:
    return F.to_timestamp(F.lit(text))


def r6(c: Column | str) -> Column:
    """Six places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events in the form that the engine takes: user as source, type as site, item number as title."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").alias("ingest_seq"),
        F.concat("event_type", F.lit(".example.org")).alias("site"), F.when(F.col("event_type") == "purchase", F.lit("search")).otherwise(F.lit("visit")).alias("kind"),
        F.concat(F.lit("item number "), F.get_json_object("props", "$.k")).alias("title"), F.lit(None).cast("string").alias("query"),
        F.floor("value").cast("long").alias("secs"), F.col("ts").cast("timestamp").alias("observed_at"), F.lit(1).cast("long").alias("capture_epoch"), F.lit(0).cast("long").alias("site_epoch"),
    )


#: The same in SQL, as the first common table of a statement.
OBS = """obs AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id, event_type || '.example.org' AS site,
  CASE WHEN event_type = 'purchase' THEN 'search' ELSE 'visit' END AS kind, 'item number ' || json_extract_string(props, '$.k') AS title,
  CAST(floor(value) AS BIGINT) AS dwell, ts FROM events)"""
ATOM = "sha256(concat_ws(chr(0), '', source, site, kind, title, ''))"
MASS = "CASE WHEN kind = 'search' THEN 1.0::DOUBLE ELSE least(0.75::DOUBLE, 0.25::DOUBLE + 0.5::DOUBLE * dwell / 60.0::DOUBLE) END"
SESSION = "source || ':1:' || CAST(CAST(floor(epoch(ts) / 1800) AS BIGINT) AS VARCHAR)"
CELLS = f"cells AS (SELECT {ATOM} AS atom, source, site, CAST(ts AS DATE) AS dday, {SESSION} AS sess, max({MASS}) AS mass FROM obs GROUP BY ALL)"
