"""Corrections: an append-only history, resolved by write order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import ACTIONS

#: Actions that keep a record out of recall for good; and those that keep it out of groups.
SUPPRESS = ("do_not_use", "wrong_topic")
EXCLUDE = ("do_not_use", "wrong_topic", "not_about_me", "temporary_research")


def valid_feedback(rows: DataFrame, records: DataFrame) -> DataFrame:
    """rows with ``error``: an unknown action, a confirmation without a usable text, or no such record."""
    known = records.select("atom").distinct().withColumn("known", F.lit(True))
    bad_text = F.col("text").isNull() | (F.trim("text") == "") | (F.length("text") > 512) | text.sensitive("text")
    error = F.coalesce(
        F.when(~F.col("action").isin(*ACTIONS), F.lit("UNKNOWN_ACTION")),
        F.when((F.col("action") == "confirm_constraint") & bad_text, F.lit("BAD_TEXT")),
        F.when(F.col("known").isNull(), F.lit("NOT_FOUND")),
    )
    return rows.join(known, "atom", "left").withColumn("error", error).drop("known")


def resolve(feedback: DataFrame) -> DataFrame:
    """One row for each corrected record.

    ``suppressed`` and ``excluded`` are sticky; the latest confirmation is that of the greatest ``seq``, never of the
    latest time, and may carry a null text; ``history`` is in write order."""
    confirm = F.col("action") == "confirm_constraint"
    latest = F.max_by(F.struct("seq", "text"), F.when(confirm, F.col("seq")))
    folded = feedback.groupBy("atom").agg(
        F.bool_or(F.col("action").isin(*SUPPRESS)).alias("suppressed"),
        F.bool_or(F.col("action").isin(*EXCLUDE)).alias("excluded"),
        F.bool_or(F.col("action") == "not_about_me").alias("about_other"),
        F.max(F.when(confirm, F.col("seq"))).alias("confirmed_seq"),
        latest.alias("l"),
        F.array_sort(F.collect_list(F.struct("seq", "action", "text"))).alias("history"),
    )
    return folded.withColumn("confirmed_text", F.when(F.col("confirmed_seq").isNotNull(), F.col("l.text"))).drop("l")


def effective(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """records with state, effective text, subject and corrections. A confirmation with a null text leaves no text, so
    the record has none to show and is dropped; it is never replaced by an older text."""
    joined = records.join(resolved, "atom", "left")
    confirmed = F.col("confirmed_seq").isNotNull()
    subject = F.when(F.coalesce("about_other", F.lit(False)), F.lit("other")).when(confirmed, F.lit("self")).otherwise(F.lit("unknown"))
    out = joined.withColumns({
        "state": F.when(confirmed, F.lit("confirmed")).otherwise(F.lit("observed")),
        "effective_text": F.when(confirmed, F.col("confirmed_text")).otherwise(F.coalesce("query", "title")),
        "subject": subject,
        "suppressed": F.coalesce("suppressed", F.lit(False)),
        "excluded": F.coalesce("excluded", F.lit(False)),
        "corrections": F.coalesce(F.transform(F.filter("history", lambda h: h.action != "confirm_constraint"), lambda h: h.action), F.array().cast("array<string>")),
    })
    return out.where("effective_text is not null").drop("history", "about_other")


def unsuppressed(rows: DataFrame, feedback: DataFrame) -> DataFrame:
    return rows.join(feedback.where(F.col("action").isin(*SUPPRESS)).select("atom"), "atom", "left_anti")
