"""From raw observations to records and activity masses: validate, gate, redact, deduplicate, fold, retain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Defaults
from ..functions import sites, text


def invalid_reason(as_of: Column, d: Defaults = DEFAULTS) -> Column:
    """Why an event breaks the field rules or the clock window; null if it does not."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp("observed_at")
    size = F.octet_length("title") + F.coalesce(F.octet_length("query"), F.lit(0))
    return F.when(
        F.col("observed_at").isNull() | (age < -d.future_seconds) | (age > d.retention_days * 86400)
        | (F.col("secs") > d.seconds_cap) | (F.col("secs") < 0) | ~F.col("kind").isin("visit", "search")
        | (F.length("title") > 256) | (F.coalesce(F.length("query"), F.lit(0)) > 512) | (size > 2048) | ~sites.valid_site("site"),
        F.lit("INVALID"),
    )


def late_epochs(events: DataFrame, rules: DataFrame) -> DataFrame:
    """events with ``rule_epoch`` (greatest epoch of all rules that match the site) and ``rule_excluded``.

    The suffix match is an equi-join: every host is exploded into its parents, and matches are aggregated by distinct
    (source, site) before events are joined, so the join does not multiply events."""
    hosts = events.select("source", "site").distinct()
    found = hosts.withColumn("rule", F.explode(sites.suffixes("site"))).join(rules.select("source", "rule", "epoch", "excluded"), ["source", "rule"])
    best = found.groupBy("source", "site").agg(F.max("epoch").alias("rule_epoch"), F.bool_or("excluded").alias("rule_excluded"))
    return events.join(best, ["source", "site"], "left").withColumns({"rule_epoch": F.coalesce("rule_epoch", F.lit(0)), "rule_excluded": F.coalesce("rule_excluded", F.lit(False))})


def gate_reason(d: Defaults = DEFAULTS) -> Column:
    """First policy reason against an event that is joined with its source's policy (columns prefixed ``p_``)."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.coalesce(
        F.when(~on("p_consent") | on("p_paused"), F.lit("CAPTURE_DISABLED")),
        F.when(~sites.valid_site("site") | sites.blocked_site("site") | ~sites.policy_allows("site", "p_"), F.lit("EXCLUDED_SITE")),
        F.when(text.sensitive("title") | text.sensitive("query"), F.lit("SENSITIVE_METADATA")),
        F.when((F.col("kind") == "visit") & (F.col("secs") < d.min_visit_seconds), F.lit("SHORT_VISIT")),
    )


def admit(events: DataFrame, policy: DataFrame, rules: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """events with ``reason``: the first check that fails, in the order fields, capture epoch, site epoch, policy."""
    prefixed = policy.select(F.col("source"), *[F.col(c).alias(f"p_{c}") for c in policy.columns if c != "source"])
    joined = late_epochs(events, rules).join(prefixed, "source", "left")
    reason = F.coalesce(
        invalid_reason(as_of, d),
        F.when(~F.col("capture_epoch").eqNullSafe(F.col("p_capture_epoch")), F.lit("STALE_CAPTURE_EPOCH")),
        F.when((F.col("site_epoch") != F.col("rule_epoch")) | F.col("rule_excluded"), F.lit("STALE_SITE_EPOCH")),
        gate_reason(d),
    )
    return joined.withColumn("reason", reason).select(*events.columns, "reason")


def cleaned(events: DataFrame) -> DataFrame:
    return events.withColumns({"title": text.redact("title", 256), "query": text.redact("query", 512)})


def deduplicate(events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """events with ``duplicate``: another event of the same (source, event_id) came earlier, or the ledger has it."""
    first = Window.partitionBy("source", "event_id").orderBy("ingest_seq")
    out = events.withColumn("duplicate", F.row_number().over(first) > 1)
    if seen is None:
        return out
    known = seen.select("source", "event_id").distinct().withColumn("known", F.lit(True))
    return out.join(known, ["source", "event_id"], "left").withColumn("duplicate", F.col("duplicate") | F.coalesce("known", F.lit(False))).drop("known")


def canonical_id(salt: str = "", source: str = "source", site: str = "site", kind: str = "kind", title: str = "title", query: str = "query") -> Column:
    """The record's identity: a hash of salt, source, site, kind, title and query ('' if there is none)."""
    return F.sha2(F.concat_ws("\x00", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source, site, kind, title, query)]), 256)


def fold_records(events: DataFrame, salt: str = "", d: Defaults = DEFAULTS) -> DataFrame:
    """One record for each identity: first arrival's time, last time, capped foreground seconds."""
    rows = events.withColumn("atom", canonical_id(salt))
    return rows.groupBy("atom").agg(
        *[F.min_by(c, "ingest_seq").alias(c) for c in ("source", "site", "kind", "title", "query")],
        F.min_by("observed_at", "ingest_seq").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
        F.least(F.lit(d.seconds_cap), F.sum("secs")).cast("long").alias("secs"),
    )


def attention(kind: str = "kind", secs: str = "secs") -> Column:
    """Mass of one event: 1 for a search, else by dwell up to 0.75."""
    return F.when(F.col(kind) == "search", F.lit(1.0)).otherwise(F.least(F.lit(0.75), F.lit(0.25) + F.lit(0.5) * F.col(secs) / F.lit(60.0)))


def session_key(d: Defaults = DEFAULTS) -> Column:
    """source:capture epoch:number of the fixed window."""
    return F.concat_ws(":", "source", "capture_epoch", F.floor(F.unix_timestamp("observed_at") / d.window_seconds))


def fold_activity(events: DataFrame, salt: str = "", d: Defaults = DEFAULTS) -> DataFrame:
    """(atom, day, session, mass): the greatest mass in each fixed window."""
    rows = events.select(canonical_id(salt).alias("atom"), F.to_date("observed_at").alias("day"), session_key(d).alias("session"), attention().alias("m"))
    return rows.groupBy("atom", "day", "session").agg(F.max("m").alias("mass"))


def within_capacity(records: DataFrame, existing: DataFrame, most: int, order: str = "first_seen") -> DataFrame:
    """records with ``full``: new ones beyond the capacity that the existing ones leave, by arrival."""
    room = max(0, most - existing.count())
    new = records.join(existing.select("atom"), "atom", "left_anti").select("atom", order)
    first = new.orderBy(order, "atom").limit(room).select("atom")  # each partition sends on no more than the room
    over = new.join(first, "atom", "left_anti").select("atom", F.lit(True).alias("full"))
    return records.join(over, "atom", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def receipts(admitted: DataFrame) -> DataFrame:
    """(source, outcome, reason, events): acknowledged, duplicate or rejected."""
    outcome = F.when(F.col("reason").isNotNull(), F.lit("rejected")).when(F.col("duplicate"), F.lit("duplicate")).otherwise(F.lit("acknowledged"))
    return admitted.groupBy("source", outcome.alias("outcome"), "reason").agg(F.count("*").alias("events"))


def ingest(events: DataFrame, policy: DataFrame, rules: DataFrame, as_of: Column, salt: str = "", seen: DataFrame | None = None, d: Defaults = DEFAULTS) -> dict[str, DataFrame]:
    """The whole write path: outcomes of all events, records, and activity masses of the acknowledged ones."""
    judged = admit(events, policy, rules, as_of, d)
    passed = deduplicate(judged.where("reason is null"), seen)
    outcomes = passed.unionByName(judged.where("reason is not null").withColumn("duplicate", F.lit(False)))
    kept = cleaned(passed.where("not duplicate"))
    return {"outcomes": outcomes, "records": fold_records(kept, salt, d), "activity": fold_activity(kept, salt, d)}


def retain(records: DataFrame, confirmed: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """Records seen within the retention, and confirmed ones of any age."""
    recent = F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(d.retention_days))
    marked = records.join(confirmed.select("atom").distinct().withColumn("c", F.lit(True)), "atom", "left")
    return marked.where(recent | F.col("c")).drop("c")


def prune_newest(rows: DataFrame, time: str, tie: str, most: int, as_of: Column | None = None, days: int | None = None) -> DataFrame:
    """The newest ``most`` rows, and none older than ``days``. A sort with a limit: no window over all rows."""
    fresh = rows if days is None else rows.where(F.col(time) >= as_of - F.make_dt_interval(F.lit(days)))
    return fresh.orderBy(F.desc(time), tie).limit(most)


def forget(rows: dict[str, DataFrame], site: str | None = None, atom: str | None = None) -> dict[str, DataFrame]:
    """All tables without the records of a site (and its subdomains) or of one record; nothing named: everything goes."""
    records = rows["records"]
    goes = sites.matches_any("site", [site]) if site else (F.col("atom") == atom) if atom else F.lit(True)
    gone = records.where(goes).select("atom")
    return {name: df.join(gone, "atom", "left_anti") for name, df in rows.items()}


def current_policy(versions: DataFrame) -> DataFrame:
    """The version of the greatest epoch of each source."""
    fields = [c for c in versions.columns if c != "source"]
    return versions.groupBy("source").agg(F.max_by(F.struct(*fields), "capture_epoch").alias("p")).select("source", "p.*")


def accepted_policies(versions: DataFrame, arrival: str = "seq") -> DataFrame:
    """Versions in arrival order with ``status``: applied, replay (equal to the last one applied) or stale (lower epoch)."""
    before = Window.partitionBy("source").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("capture_epoch").over(before)
    return versions.withColumn("status", F.when(top.isNull() | (F.col("capture_epoch") > top), F.lit("applied")).when(F.col("capture_epoch") == top, F.lit("replay")).otherwise(F.lit("stale")))


def status(records: DataFrame, vectors: DataFrame, topics: DataFrame, model: str) -> DataFrame:
    """(source, atoms, pending, secs): counters; pending lack a vector of the model or a topic."""
    done = vectors.where(F.col("model") == model).select("atom").join(topics.select("atom").distinct(), "atom", "left_semi").withColumn("done", F.lit(True))
    return records.join(done, "atom", "left").groupBy("source").agg(F.count("*").alias("atoms"), F.count_if(F.col("done").isNull()).alias("pending"), F.sum("secs").alias("secs"))


def pending(records: DataFrame, vectors: DataFrame, topics: DataFrame, skips: DataFrame, model: str, dimensions: int, most: int = 256) -> DataFrame:
    """Records that still need a vector or a topic, oldest first, at most ``most``."""
    from ..functions.vectors import valid

    good = vectors.where((F.col("model") == model) & valid("vector", dimensions)).select("atom").distinct()
    placed = topics.select("atom").unionByName(skips.where(F.col("model") == model).select("atom")).distinct()
    marked = records.join(good.withColumn("v", F.lit(True)), "atom", "left").join(placed.withColumn("t", F.lit(True)), "atom", "left")
    need = F.when(F.col("v").isNull(), F.lit("vector")).when(F.col("t").isNull(), F.lit("topic"))
    return marked.withColumn("need", need).where("need is not null").orderBy("first_seen", "atom").limit(most).drop("v", "t")


def copy_check(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(old_rows, new_rows, missing, mismatched): null-safe comparison of a copied table by key."""
    fields = [c for c in old.columns if c != key]
    b = new.select(F.col(key).alias("k"), *[F.col(c).alias(f"n_{c}") for c in fields])
    joined = old.join(b, old[key] == b["k"], "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    sums = joined.agg(F.count("*").alias("old_rows"), F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k").isNotNull() & differs).alias("mismatched"))
    return sums.crossJoin(new.agg(F.count("*").alias("new_rows")))


def generation(changes: DataFrame) -> DataFrame:
    """(source, evidence, privacy): snapshot counters from a log of changes (source, kind)."""
    return changes.groupBy("source").agg(F.count_if(F.col("kind") == "evidence").alias("evidence"), F.count_if(F.col("kind") == "privacy").alias("privacy"))
