"""Capture as Structured Streaming: the same operators on unbounded input.

Delivery is at least once, the ledger makes it effectively once: events are deduplicated by id within the watermark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Defaults
from ..functions.sites import site_matches, suffixes
from ..operators import ingest


def admitted(stream: DataFrame, policy: DataFrame, rules: DataFrame, as_of: Column | None = None, d: Defaults = DEFAULTS) -> DataFrame:
    """Judged events. Policy and rules are static sides, read anew with every micro-batch, so a change of control data holds
    before the data that come after it. The clock is the stream's own unless given."""
    now = F.current_timestamp() if as_of is None else as_of
    prefixed = policy.select(F.col("source"), *[F.col(c).alias(f"p_{c}") for c in policy.columns if c != "source"])
    grouped = rules.groupBy("source").agg(F.collect_list(F.struct("rule", "epoch", "excluded")).alias("_rules"))  # at most 500 rules a source by contract
    rows = stream.join(prefixed, "source", "left").join(grouped, "source", "left")
    hit = F.filter("_rules", lambda r: site_matches(F.col("site"), r.rule))
    rows = rows.withColumns({"rule_epoch": F.coalesce(F.array_max(F.transform(hit, lambda r: r.epoch)), F.lit(0)), "rule_excluded": F.coalesce(F.exists(hit, lambda r: r.excluded), F.lit(False))})
    reason = F.coalesce(ingest.invalid_reason(now, d), F.when(~F.col("capture_epoch").eqNullSafe(F.col("p_capture_epoch")), F.lit("STALE_CAPTURE_EPOCH")), F.when((F.col("site_epoch") != F.col("rule_epoch")) | F.col("rule_excluded"), F.lit("STALE_SITE_EPOCH")), ingest.gate_reason(d))
    return rows.withColumn("reason", reason).select(*stream.columns, "reason")


def once(stream: DataFrame, time: str = "observed_at", delay: str = "7 days") -> DataFrame:
    """Each (source, event_id) once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "event_id"])


def window_masses(stream: DataFrame, keys: list[str], time: str = "observed_at", delay: str = "10 minutes", d: Defaults = DEFAULTS) -> DataFrame:
    """(keys, window, mass, events): greatest attention mass and events of each fixed window, emitted when it closes."""
    rows = stream.withWatermark(time, delay).withColumn("m", ingest.attention())
    return rows.groupBy(*keys, F.window(time, f"{d.window_seconds} seconds").alias("w")).agg(F.max("m").alias("mass"), F.count("*").alias("events")).select(*keys, F.col("w.start").alias("start"), "mass", "events")


VISIT = "source string, event_id string, visit_id string, identity string, first_seen timestamp, last_seen timestamp, secs double, partial boolean"
VISIT_STATE = "identity string, first_seen timestamp, last_seen timestamp, secs double, part int"


def visits(stream: DataFrame, source: str = "source", identity: str = "identity", time: str = "observed_at", most: float = 65.0, cap: float = 3600.0, idle: str = "60 seconds", delay: str = "10 minutes", min_secs: float = DEFAULTS.min_visit_seconds) -> DataFrame:
    """Visits by change of identity: a stateful fold for each source. A visit is emitted when the identity changes. When
    the watermark has passed ``idle`` after its last tick a partial one is emitted under an event id of its own, and its
    dwell starts again from nothing. Short ones are dropped. ``delay``: how late a tick may come.

    Timers run on event time, so a bounded run (all that is available) ends, and a replay gives the same rows. Ids are
    hashes of the source, the identity, the visit's begin and the part's number."""
    names, wait = [c.split()[0] for c in VISIT.split(", ")], pd.Timedelta(idle)

    def row(who: str, keep: tuple, partial: bool) -> tuple:
        visit = hashlib.sha256(f"{who}\0{keep[0]}\0{pd.Timestamp(keep[1]).isoformat()}".encode()).hexdigest()
        return who, f"{visit[:32]}-{keep[4]}", visit[:32], *keep[:4], partial

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        keep = state.get if state.exists else None
        if state.hasTimedOut:
            if keep[3] >= min_secs:
                out.append(row(key[0], keep, True))
                state.update((*keep[:3], 0.0, keep[4] + 1))
            else:
                state.remove()
        else:
            ticks = sorted((at, who) for b in batches for at, who in zip(b[time], b[identity]))
            for at, who in ticks:
                if keep is not None:
                    total = min(cap, keep[3] + min(most, max(0.0, (at - keep[2]).total_seconds())))
                    if keep[0] == who:
                        keep = (who, keep[1], max(at, keep[2]), total, keep[4])
                        continue
                    if total >= min_secs:
                        out.append(row(key[0], (*keep[:3], total, keep[4]), False))
                keep = (who, at, at, 0.0, 0)
            state.update(keep)
            state.setTimeoutTimestamp(max(int((keep[2] + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    rows = stream.select(F.col(source).alias("source"), F.col(identity).alias(identity), F.col(time).alias(time)).withWatermark(time, delay)
    return rows.groupBy("source").applyInPandasWithState(fold, VISIT, VISIT_STATE, "append", "EventTimeTimeout")


#: Events that wait for delivery at a source, and their bytes; events and bytes of one delivery.
OUTBOX, OUTBOX_BYTES, DELIVERY, DELIVERY_BYTES = 2000, 2 * 1024 * 1024, 32, 64_000


def outbox(queue: DataFrame, event: Column | None = None) -> DataFrame:
    """queue (source, event_id, observed_at, ...) without what a source's bounded outbox drops: the oldest, beyond
    ``OUTBOX`` events or ``OUTBOX_BYTES`` bytes as JSON."""
    bytes_ = F.octet_length(F.to_json(F.struct(*queue.columns)) if event is None else event) + 1
    newest = Window.partitionBy("source").orderBy(F.desc("observed_at"), F.desc("event_id"))
    marked = queue.withColumn("_bytes", bytes_).withColumns({"_n": F.row_number().over(newest), "_sum": F.sum("_bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0)) + 1})
    return marked.where((F.col("_n") <= OUTBOX) & (F.col("_sum") <= OUTBOX_BYTES)).select(*queue.columns)


def deliveries(queue: DataFrame, event: Column | None = None) -> DataFrame:
    """queue with ``delivery``: its events in order of time, as many to a delivery as its limits of events and bytes
    allow. One fold for each source, over at most an outbox."""
    text = F.to_json(F.struct(*queue.columns)) if event is None else event
    order = F.array_sort(F.collect_list(F.struct("observed_at", "event_id", (F.octet_length(text) + 1).alias("bytes"))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(1).alias("bytes"), F.array().cast("array<struct<event_id:string,delivery:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        fits = (s.n == 0) | ((s.n < DELIVERY) & (s.bytes + e.bytes <= DELIVERY_BYTES))
        at = F.when(fits, s.at).otherwise(s.at + 1)
        done = F.array_append(s.out, F.struct(e.event_id.alias("event_id"), at.alias("delivery")))
        return F.struct(at.alias("at"), F.when(fits, s.n + 1).otherwise(1).alias("n"), F.when(fits, s.bytes + e.bytes).otherwise(1 + e.bytes).alias("bytes"), done.alias("out"))

    one = queue.groupBy("source").agg(F.aggregate(order, start, step, lambda s: s.out).alias("d")).select("source", F.explode("d").alias("d")).select("source", "d.*")
    return queue.join(one, ["source", "event_id"])


def micro_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds", available_now: bool = False) -> object:
    """Start a query that hands batches to an idempotent sink."""
    out = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)).start()


def purge(queue: DataFrame, transitions: DataFrame) -> DataFrame:
    """Queued events without those that a privacy transition (source, site, epoch) covers: its site and subdomains, older epochs."""
    marked = queue.withColumn("site_or_parent", F.explode(suffixes("site")))
    cut = transitions.select("source", F.col("site").alias("site_or_parent"), F.col("epoch").alias("cut"))
    gone = marked.join(cut, ["source", "site_or_parent"]).where(F.col("site_epoch") < F.col("cut")).select("source", "event_id").distinct()
    return queue.join(gone, ["source", "event_id"], "left_anti")
