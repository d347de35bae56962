"""Streams give what batches give."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.catalog.base import observations
from tidemark.operators import ingest
from tidemark.schema import POLICY, SITE_RULE
from tidemark.streaming import capture

DATA = "/root/testdata/sf0.001"


def drain(writer):
    query = writer.trigger(availableNow=True).start()
    assert query.awaitTermination(90)


def test_admission_and_dedup_equal_batch(spark, tmp_path):
    obs = observations(spark, DATA).withColumn("visit_id", F.lit("v"))
    for k in (0, 1):
        obs.where(F.col("ingest_seq") % 3 >= k).write.mode("append").parquet(str(tmp_path / "in"))
    users = [r.source for r in obs.select("source").distinct().collect()]
    policy = spark.createDataFrame([(u, True, False, True, False, [], ["error.example.org"], 1) for u in users], POLICY)
    rules = spark.createDataFrame([(u, "click.example.org", 1, False) for u in users[:3]], SITE_RULE)
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    as_of = F.to_timestamp(F.lit("2024-01-31T00:00:00Z"))
    judged = capture.admitted(capture.once(stream, delay="60 days"), policy, rules, as_of)
    drain(judged.writeStream.format("memory").queryName("judged").outputMode("append"))
    got = {(r.event_id, r.reason) for r in spark.table("judged").collect()}
    want = {(r.event_id, r.reason) for r in ingest.admit(obs, policy, rules, as_of).collect()}
    assert got == want and spark.table("judged").count() == len(want)


def test_window_masses_equal_batch(spark, tmp_path):
    obs = observations(spark, DATA)
    # a late marker closes all windows
    last = obs.limit(1).withColumns({"observed_at": F.to_timestamp(F.lit("2025-01-01T00:00:00Z")), "source": F.lit("marker")})
    obs.orderBy("observed_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    last.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    out = capture.window_masses(stream, ["source", "site"], delay="90 days")
    drain(out.writeStream.format("memory").queryName("masses").outputMode("append"))
    got = {(r.source, r.site, r.start, r.mass, r.events) for r in spark.table("masses").collect()}
    batch = obs.groupBy("source", "site", F.window("observed_at", "30 minutes").alias("w")).agg(F.max(ingest.attention()).alias("mass"), F.count("*").alias("events"))
    assert got == {(r.source, r.site, r.w.start, r.mass, r.events) for r in batch.collect()}


def test_visits_fold(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", "a", at), ("s", "a", at + dt.timedelta(seconds=10)), ("s", "b", at + dt.timedelta(seconds=30)), ("s", "b", at + dt.timedelta(seconds=31)), ("s", "c", at + dt.timedelta(seconds=33))]
    spark.createDataFrame(rows, "source string, identity string, observed_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, identity string, observed_at timestamp").parquet(str(tmp_path / "in"))
    drain(capture.visits(stream).writeStream.format("memory").queryName("visits").outputMode("append"))
    assert [(r.identity, r.secs, r.partial) for r in spark.table("visits").collect()] == [("a", 30.0, False)]


def test_visits_time_out(spark, tmp_path):
    """Ticks of another source move the watermark past the idle time: a partial visit with an event id of its own."""
    at = dt.datetime(2024, 1, 1)
    first = [("s", "a", at), ("s", "a", at + dt.timedelta(seconds=20)), ("t", "x", at)]
    later = [("t", "x", at + dt.timedelta(hours=2))]
    last = [("s", "a", at + dt.timedelta(hours=2, seconds=5)), ("s", "b", at + dt.timedelta(hours=2, seconds=6))]
    kind = "source string, identity string, observed_at timestamp"
    (tmp_path / "in").mkdir()
    out = capture.visits(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), delay="1 minute")
    for rows in (first, later, last):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(90)
    got = sorted((r.identity, r.secs, r.partial, r.event_id[-2:]) for r in spark.read.parquet(str(tmp_path / "out")).where("source = 's'").collect())
    # the gap after a time-out counts as at most 65 s, as any
    assert got == [("a", 20.0, True, "-0"), ("a", 66.0, False, "-1")]
    assert len({r.visit_id for r in spark.read.parquet(str(tmp_path / "out")).where("source = 's'").collect()}) == 1


def test_outbox_and_deliveries(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("s", f"{i:05}", at + dt.timedelta(seconds=i), "x" * (3000 if i % 2 else 100)) for i in range(2100)] + [("t", "1", at, "y")]
    queue = spark.createDataFrame(rows, "source string, event_id string, observed_at timestamp, title string")
    event = F.col("title")  # its bytes stand for the event's
    kept = capture.outbox(queue, event)
    want, size = [], 1
    for s, i, _, t in sorted(rows, key=lambda r: r[1], reverse=True):
        if s == "s":
            size += len(t) + 1
            if len(want) < capture.OUTBOX and size <= capture.OUTBOX_BYTES:
                want.append(i)
    assert {r.event_id for r in kept.where("source = 's'").collect()} == set(want)
    got = {(r.source, r.event_id): r.delivery for r in capture.deliveries(kept, event).collect()}
    number, n, size = 0, 0, 1
    text = {i: t for s, i, _, t in rows if s == "s"}
    for i in sorted(want):
        if n and (n == capture.DELIVERY or size + len(text[i]) + 1 > capture.DELIVERY_BYTES):
            number, n, size = number + 1, 0, 1
        n, size = n + 1, size + len(text[i]) + 1
        assert got["s", i] == number
    assert got["t", "1"] == 0


def test_purge(spark):
    queue = spark.createDataFrame([("s", "1", "a.b.org", 1), ("s", "2", "b.org", 5), ("s", "3", "c.org", 1)], "source string, event_id string, site string, site_epoch long")
    cut = spark.createDataFrame([("s", "b.org", 5)], "source string, site string, epoch long")
    assert {r.event_id for r in capture.purge(queue, cut).collect()} == {"2", "3"}
