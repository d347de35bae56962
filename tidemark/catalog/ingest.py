"""Write-path queries: outcomes, replays, records, retention, forgetting, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from .base import ATOM, OBS, as_of, observations, query, table

#: Policies, rules and odd rows made from the events' own keys, so that every outcome occurs.
CASES = """cases AS (SELECT CAST(user_id AS VARCHAR) AS source, user_id, event_id, event_type || '.example.org' AS site, CASE WHEN event_type = 'purchase' THEN 'search' ELSE 'visit' END AS kind,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) = 13 THEN 'patient item' ELSE 'item number ' || json_extract_string(props, '$.k') END AS title,
  CASE WHEN event_id % 211 = 0 THEN 4000 ELSE CAST(floor(value) AS BIGINT) END AS dwell, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 1 END AS capture_epoch, ts FROM events)"""
REASON = """CASE WHEN dwell > 3600 OR date_diff('second', ts, TIMESTAMP '2024-02-15 00:00:00') > 90 * 86400 OR date_diff('second', ts, TIMESTAMP '2024-02-15 00:00:00') < -300 THEN 'INVALID'
  WHEN capture_epoch <> 1 THEN 'STALE_CAPTURE_EPOCH' WHEN user_id % 7 = 0 AND site = 'purchase.example.org' THEN 'STALE_SITE_EPOCH' WHEN user_id % 10 = 0 THEN 'CAPTURE_DISABLED'
  WHEN user_id % 3 = 0 AND site = 'error.example.org' THEN 'EXCLUDED_SITE' WHEN title = 'patient item' THEN 'SENSITIVE_METADATA' WHEN kind = 'visit' AND dwell < 5 THEN 'SHORT_VISIT' END"""


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    obs = observations(spark, sf_dir)
    k = F.col("ingest_seq")
    events = obs.withColumns({
        "title": F.when(F.col("title") == "item number 13", F.lit("patient item")).otherwise(F.col("title")),
        "secs": F.when(k % 211 == 0, F.lit(4000)).otherwise(F.col("secs")).cast("long"), "capture_epoch": F.when(k % 50 == 0, F.lit(0)).otherwise(F.lit(1)).cast("long"),
    })
    users = obs.select("source").distinct()
    n = F.col("source").cast("long")
    none = F.array().cast("array<string>")
    policy = users.select("source", F.lit(True).alias("consent"), (n % 10 == 0).alias("paused"), F.lit(True).alias("recall_enabled"), F.lit(False).alias("selected_only"), none.alias("selected_sites"), F.when(n % 3 == 0, F.array(F.lit("error.example.org"))).otherwise(none).alias("excluded_sites"), F.lit(1).cast("long").alias("capture_epoch"))
    rules = users.where(n % 7 == 0).select("source", F.lit("purchase.example.org").alias("rule"), F.lit(2).cast("long").alias("epoch"), F.lit(False).alias("excluded"))
    return events, policy, rules


@query(f"""WITH {CASES}, judged AS (SELECT source, {REASON} AS reason, event_id FROM cases),
replayed AS (SELECT *, FALSE AS dup FROM judged UNION ALL SELECT *, TRUE FROM judged WHERE event_id % 20 = 0)
SELECT source, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN dup THEN 'duplicate' ELSE 'acknowledged' END AS outcome, reason, count(*) AS n_events FROM replayed GROUP BY ALL""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of all events and some replays: acknowledged, duplicate or rejected, and why."""
    events, policy, rules = _cases(spark, sf_dir)
    replay = events.where(F.col("ingest_seq") % 20 == 0).withColumn("ingest_seq", F.col("ingest_seq") + (1 << 40))
    out = ingest.ingest(events.unionByName(replay), policy, rules, as_of("2024-02-15T00:00:00Z"))["outcomes"]
    return ingest.receipts(out).withColumnRenamed("events", "n_events")


@query("""SELECT user_id, count(*) AS n_events, count(DISTINCT event_id) AS n_kept FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) GROUP BY user_id""")
def dedup_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that stay when a third arrives twice."""
    obs = observations(spark, sf_dir)
    both = ingest.deduplicate(obs.unionByName(obs.where(F.col("ingest_seq") % 3 == 0).withColumn("ingest_seq", F.col("ingest_seq") + (1 << 40))))
    return both.groupBy(F.col("source").cast("long").alias("user_id")).agg(F.count("*").alias("n_events"), F.count_if(~F.col("duplicate")).alias("n_kept"))


@query(f"""WITH {OBS} SELECT {ATOM} AS atom, source, site, kind, title, CAST(epoch_us(arg_min(ts, event_id)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, CAST(least(3600, sum(dwell)) AS BIGINT) AS secs_total FROM obs GROUP BY ALL""")
def canonical_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by canonical identity."""
    out = ingest.fold_records(observations(spark, sf_dir))
    return out.select("atom", "source", "site", "kind", "title", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), F.col("secs").alias("secs_total"))


@query(f"""WITH {OBS}, rec AS (SELECT {ATOM} AS atom, source, max(ts) AS last_seen FROM obs GROUP BY ALL), conf AS (SELECT CAST(doc_id AS VARCHAR) AS source FROM labels WHERE quality = 1)
SELECT source, count(*) AS n_kept FROM rec WHERE last_seen >= TIMESTAMP '2024-01-20 00:00:00' OR source IN (SELECT source FROM conf) GROUP BY source""")
def retention_keep_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent records and confirmed ones of any age."""
    records = ingest.fold_records(observations(spark, sf_dir))
    confirmed = records.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("source")), "source", "left_semi")
    return ingest.retain(records, confirmed, as_of("2024-04-19T00:00:00Z")).groupBy("source").agg(F.count("*").alias("n_kept"))


@query("""SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' ORDER BY ts DESC, event_id LIMIT 2000""")
def newest_n_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's newest rows of the last seven days."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return ingest.prune_newest(e, "at", "event_id", 2000, as_of(), 7).select("event_id", "user_id")


HOST = "regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)"


@query(f"""WITH rec AS (SELECT page_id, {HOST} AS site FROM pages), gone AS (SELECT min(site) AS rule FROM rec)
SELECT 'records' AS kept_in, count(*) AS n FROM rec, gone WHERE NOT (site = rule OR site LIKE '%.' || rule) UNION ALL
SELECT 'activity', count(*) FROM rec, gone WHERE NOT (site = rule OR site LIKE '%.' || rule) AND page_id % 2 = 0""")
def forget_site_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a site is forgotten, in records and in what derives from them."""
    from ..functions.text import url_parts

    records = table(spark, sf_dir, "pages").select(F.col("page_id").alias("atom"), url_parts("url")[0].alias("site"))
    rule = records.agg(F.min("site")).first()[0]
    left = ingest.forget({"records": records, "activity": records.where("atom % 2 = 0")}, site=rule)
    return left["records"].agg(F.lit("records").alias("kept_in"), F.count("*").alias("n")).unionByName(left["activity"].agg(F.lit("activity").alias("kept_in"), F.count("*").alias("n")))


@query(f"""WITH {OBS}, rec AS (SELECT {ATOM} AS atom, source, title, least(3600, sum(dwell)) AS total FROM obs GROUP BY source, site, kind, title)
SELECT source, count(*) AS atoms, count(*) FILTER (WHERE CAST(substr(title, 13) AS BIGINT) % 4 <> 0) AS pending, CAST(sum(total) AS BIGINT) AS secs_total FROM rec GROUP BY source""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each source; a quarter of the records has vectors and topics."""
    records = ingest.fold_records(observations(spark, sf_dir))
    done = records.where(F.substring("title", 13, 10).cast("long") % 4 == 0).select("atom", F.lit("m").alias("model"))
    return ingest.status(records, done, done, "m").withColumnRenamed("secs", "secs_total")


@query("""WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 100 = 7 THEN NULL ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 50 <> 3)
SELECT (SELECT count(*) FROM orders) AS old_rows, (SELECT count(*) FROM b) AS new_rows, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS missing, count(*) FILTER (WHERE b.o_orderkey IS NOT NULL AND (o.o_totalprice IS DISTINCT FROM b.p OR o.o_custkey IS DISTINCT FROM b.o_custkey)) AS mismatched
FROM orders o LEFT JOIN b ON o.o_orderkey = b.o_orderkey""")
def copy_check_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copied table against its origin, null-safe."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_orderkey % 50 <> 3").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 != 7, F.col("o_totalprice")))
    return ingest.copy_check(old, new, "o_orderkey").select("old_rows", "new_rows", "missing", "mismatched")


@query(f"""WITH {OBS}, rec AS (SELECT {ATOM} AS atom, arg_min(ts, event_id) AS first_seen, title FROM obs GROUP BY source, site, kind, title)
SELECT atom, CASE WHEN CAST(substr(title, 13) AS BIGINT) % 2 = 1 THEN 'vector' ELSE 'topic' END AS need FROM rec WHERE NOT CAST(substr(title, 13) AS BIGINT) % 4 = 0 ORDER BY first_seen, atom LIMIT 256""")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest records that lack a valid vector, or a topic."""
    records = ingest.fold_records(observations(spark, sf_dir))
    n = F.substring("title", 13, 10).cast("long")
    vectors = records.where(n % 2 == 0).select("atom", F.lit("m").alias("model"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    topics = records.where(n % 8 == 0).select("atom")
    skips = records.where(n % 8 == 4).select("atom", F.lit("m").alias("model"))
    return ingest.pending(records, vectors, topics, skips, "m", 2).select("atom", "need")


@query("""WITH v AS (SELECT o_orderkey AS seq, o_custkey, (o_orderkey * 7) % 5 AS epoch FROM orders), w AS (SELECT *, max(epoch) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM v)
SELECT CASE WHEN top IS NULL OR epoch > top THEN 'applied' WHEN epoch = top THEN 'replay' ELSE 'stale' END AS state, count(*) AS n FROM w GROUP BY ALL""")
def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy updates by monotone epoch."""
    v = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("source"), ((F.col("o_orderkey") * 7) % 5).alias("capture_epoch"))
    return ingest.accepted_policies(v).groupBy(F.col("status").alias("state")).agg(F.count("*").alias("n"))
