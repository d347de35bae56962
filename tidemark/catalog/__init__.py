"""Registered queries of the observation engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import activity, ingest, relational, retrieval, texts, vectors
from .base import ORACLES, QUERIES

flagship = activity.decayed_activity_top
__all__ = ["activity", "flagship", "ingest", "oracle_sql", "queries", "relational", "retrieval", "texts", "vectors"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
