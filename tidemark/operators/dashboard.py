"""Grouped summaries for people: cards, memories, client-side filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Defaults
from ..functions import sites, text


def cards(records: DataFrame, most: int = 60) -> DataFrame:
    """The newest records as cards. records: effective rows with ``sessions``."""
    shown = text.prominent("title", "query", "secs", "sessions", F.col("state") == "confirmed") & ~F.col("excluded")
    return records.select("atom", "site", F.col("effective_text").alias("text"), "state", "last_seen", "sessions", "kind", shown.alias("prominent"), "corrections").orderBy(F.desc("last_seen"), "atom").limit(most)


def group_candidates(records: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Records that may stand in a group: meaningful, allowed by policy, not excluded by a correction."""
    fine = text.groupable("title", "query") & ~F.col("excluded")
    return records.where(fine if allowed is None else fine & allowed)


def topic_labels(items: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(topic, label): the first meaningful text by recency, else an observed title, else 'Research'."""
    meaningful = text.informative_title("effective_text")
    order = F.struct(-F.unix_micros("last_seen"), F.col("atom"))
    by_text = F.min_by(F.col("effective_text"), F.when(meaningful, order))
    by_title = F.min_by(F.col("title"), F.when((F.col("state") == "observed") & text.informative_title("title"), order))
    out = items.groupBy("topic").agg(F.when(F.bool_or(meaningful), by_text).alias("a"), F.when(F.bool_or((F.col("state") == "observed") & text.informative_title("title")), by_title).alias("b"))
    return out.select("topic", F.substring(F.coalesce("a", "b", F.lit("Research")), 1, d.label_chars).alias("label"))


def memories(items: DataFrame, windows: DataFrame, most: int = 8, shown: int = 5) -> DataFrame:
    """Topics worth remembering: at least two items, and either two activity windows, or one window with a search and
    at least two other items. items: group candidates with ``topic``; windows: (atom, session)."""
    joined = windows.select("atom", "session").distinct().join(items.select("atom", "topic", "kind"), "atom")
    per = joined.groupBy("topic", "session").agg(F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") != "search").alias("others"))
    rule = per.groupBy("topic").agg(F.count("*").alias("sessions"), F.bool_or((F.col("searches") >= 1) & (F.col("others") >= 2)).alias("coherent"))
    entry = F.struct((-F.unix_micros("last_seen")).alias("o"), "atom", F.col("effective_text").alias("text"))
    whole = items.groupBy("topic").agg(
        F.count("*").alias("evidence_count"), F.countDistinct("site").alias("sites"), F.max("last_seen").alias("last_seen"),
        F.transform(F.slice(F.array_sort(F.collect_list(entry)), 1, shown), lambda e: F.struct(e.atom.alias("atom"), e.text.alias("text"))).alias("items"),
    )
    out = whole.join(rule, "topic").where((F.col("evidence_count") >= 2) & ((F.col("sessions") >= 2) | F.col("coherent")))
    return out.join(topic_labels(items), "topic").select("topic", "label", "last_seen", "sessions", "sites", "evidence_count", "items").orderBy(F.desc("last_seen"), "topic").limit(most)


def client_filter(shown: DataFrame, state: str | None = None, words: str | None = None) -> DataFrame:
    """Cards of a state whose text or site contains the words in any case."""
    out = shown if state is None else shown.where(F.col("state") == state)
    return out if not words else out.where(F.contains(F.lower(F.concat_ws(" ", "text", "site")), F.lit(words.lower())))


def memory_filter(groups: DataFrame, words: str) -> DataFrame:
    """Groups whose label contains the words, whole; of the others only the items that do."""
    low = words.lower()
    by_label = F.contains(F.lower("label"), F.lit(low))
    items = F.when(by_label, F.col("items")).otherwise(F.filter("items", lambda i: F.contains(F.lower(i.text), F.lit(low))))
    return groups.withColumn("items", items).where(F.size("items") > 0)


def loose_prominent(shown: DataFrame, groups: DataFrame, most: int = 6) -> DataFrame:
    """Prominent cards that no memory has, the newest first."""
    held = groups.select(F.explode("items").alias("i")).select("i.atom")
    return shown.where("prominent").join(held, "atom", "left_anti").orderBy(F.desc("last_seen"), "atom").limit(most)


def allowed_by(policy_prefix: str = "p_") -> Column:
    return sites.policy_allows("site", policy_prefix)
