"""Packets: a bounded, ordered selection of ranked records under caps and a byte budget."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Defaults
from ..schema import PACKET

LIMITS = ("Browsing does not establish endorsement, ownership, or a settled preference.", "Activity counts use fixed 30-minute windows; they are not independent confirmations.")


def record_text() -> Column:
    """Text of a record by its state, query and title."""
    search = F.format_string("Observed search on %s: %s; page title: %s", "site", "effective_text", "title")
    plain = F.format_string("Observed %s on %s: %s", F.when(F.col("query").isNotNull(), F.lit("search")).otherwise(F.lit("page title")), F.col("site"), F.col("effective_text"))
    return F.when(F.col("state") == "confirmed", F.col("effective_text")).when(F.col("query").isNotNull() & (F.col("title") != F.col("effective_text")), search).otherwise(plain)


def record_limits() -> Column:
    """Standing cautions, then the record's corrections."""
    own = F.transform("corrections", lambda a: F.concat(F.lit("User correction: "), F.replace(a, F.lit("_"), F.lit(" "))))
    return F.concat(F.array(*[F.lit(x) for x in LIMITS]), own)


def formatted(rows: DataFrame) -> DataFrame:
    """rows with ``record``: the JSON object that a packet carries."""
    confirmed = F.col("state") == "confirmed"
    body = F.struct(
        F.col("atom").alias("id"), F.when(confirmed, F.lit("constraint")).otherwise(F.lit("research_topic")).alias("kind"), "state", record_text().alias("text"), "subject",
        F.struct(F.col("sessions"), F.lit(1).alias("sites")).alias("evidence"), F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_seen"), record_limits().alias("limits"),
    )
    return rows.withColumn("record", F.to_json(body))


def _fill(rows: pd.DataFrame, max_bytes: int, d: Defaults, arms: int) -> list[tuple[int, int]]:
    """(row, bytes so far) in the order of choice: uncovered arms first, then group order; the next member on failure."""
    chosen: list[tuple[int, int]] = []
    used, size, covered, per_site = set(), d.packet_margin, 0, {}
    groups = [g for _, g in rows.sort_values(["group_rank", "rank"]).groupby("group_rank", sort=True)]

    def take(i: int) -> bool:
        nonlocal size
        site, n = rows.at[i, "site"], len(rows.at[i, "record"].encode()) + bool(chosen)
        if per_site.get(site, 0) >= d.records_per_site or size + n > max_bytes:
            return False
        per_site[site] = per_site.get(site, 0) + 1
        size += n
        chosen.append((i, size))
        return True

    while arms and covered != arms and len(chosen) < d.context_records:
        pick = next(((k, i) for k, g in enumerate(groups) if k not in used for i in g.index if int(g.at[i, "arms"]) & arms & ~covered and take(i)), None)
        if pick is None:
            break
        used.add(pick[0])
        covered |= int(rows.at[pick[1], "arms"])
    for k, g in enumerate(groups):
        if len(chosen) >= d.context_records:
            break
        if k not in used and any(take(i) for i in g.index):
            used.add(k)
    return chosen


def select(ranked: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Packets of all requests: ranked is (request_id, atom, site, record, rank, group_rank, arms, all_arms, max_bytes, state_text).

    The choice is sequential by nature (each depends on the bytes before it) and is over at most the channels' capacity
    of rows a request, so each request is one small group; requests are spread over the cluster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        arms = int(rows["all_arms"].iloc[0])
        chosen = _fill(rows, int(rows["max_bytes"].iloc[0]), d, arms)
        got = 0
        for i, _ in chosen:
            got |= int(rows.at[i, "arms"])
        gap = bool(arms and chosen and got & arms != arms)
        return pd.DataFrame([(rows.at[i, "request_id"], k, rows.at[i, "atom"], rows.at[i, "site"], json.loads(rows.at[i, "record"])["text"], b, "ok", gap) for k, (i, b) in enumerate(chosen)], columns=["request_id", "position", "atom", "site", "text", "bytes", "status", "gap"])

    return ranked.groupBy("request_id").applyInPandas(run, PACKET)


def status(blocked: Column, unsupported: Column, chosen: Column, complete: Column) -> Column:
    """blocked, then partial for values that cannot be compared, then empty, then partial for a missing channel, else ok."""
    return F.when(blocked, F.lit("blocked")).when(unsupported, F.lit("partial")).when(chosen == 0, F.lit("empty")).when(~complete, F.lit("partial")).otherwise(F.lit("ok"))


def explain(ids: DataFrame, records: DataFrame, allowed: Column, max_bytes: int, most: int = 6) -> DataFrame:
    """Records by id in the caller's order ((request_id, position, atom)), gated; the list ends before the byte budget does."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("request_id").orderBy("position")
    rows = ids.where(F.col("position") < most).join(records.where(allowed), "atom")
    total = rows.withColumn("upto", F.sum(F.octet_length("record")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return total.where(F.col("upto") <= max_bytes).drop("upto")


def receipts(packets: DataFrame, requests: DataFrame, time: Column) -> DataFrame:
    """One audit row for each request: ids as JSON, bytes, status."""
    got = packets.groupBy("request_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "atom"))), lambda x: x.atom)).alias("ids"), F.max("bytes").alias("bytes"), F.first("status").alias("s"))
    return requests.select("request_id").join(got, "request_id", "left").select("request_id", F.coalesce("ids", F.lit("[]")).alias("ids"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("s", F.lit("empty")).alias("status"), time.alias("time"))

