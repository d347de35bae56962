"""Activity queries: windows, decay, shares, bursts, memories, dwell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import activity, dashboard, feedback, ingest
from .base import ATOM, CELLS, MASS, OBS, as_of, observations, query, r6, table

AGE = "greatest(date_diff('day', dday, DATE '2024-01-31'), 0)"


@query(f"""WITH {OBS}, cells AS (SELECT source, site, title, CAST(ts AS DATE) AS dday, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS w, max({MASS}) AS mass FROM obs GROUP BY ALL)
SELECT source, site, count(*) AS windows, round(sum(mass * pow(2.0::DOUBLE, -{AGE} / 7.0::DOUBLE)), 6) AS mass7
FROM cells GROUP BY source, site ORDER BY mass7 DESC, source, site LIMIT 20""")
def decayed_activity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and types with the greatest decayed mass."""
    obs = observations(spark, sf_dir)
    cells = obs.groupBy("source", "site", "title", F.to_date("observed_at").alias("day"), ingest.session_key().alias("session")).agg(F.max(ingest.attention()).alias("mass"))
    out = cells.groupBy("source", "site").agg(F.count("*").alias("windows"), r6(F.sum(F.col("mass") * activity.decay(activity.age_days("day", as_of()), 7.0))).alias("mass7"))
    return out.orderBy(F.desc("mass7"), "source", "site").limit(20)


@query(f"""WITH {OBS}, {CELLS} SELECT atom, CAST(dday AS VARCHAR) AS dday, sess AS session_key, round(mass, 6) AS mass FROM cells""")
def attention_mass_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest attention mass of each record in each fixed window."""
    out = ingest.fold_activity(observations(spark, sf_dir))
    return out.select("atom", F.col("day").cast("string").alias("dday"), F.col("session").alias("session_key"), r6("mass").alias("mass"))


TOPIC = "CAST(CAST(substr(title, 13) AS BIGINT) % 10 AS VARCHAR)"
TOPICS = f"""{CELLS}, member AS (SELECT DISTINCT {ATOM} AS atom, {TOPIC} AS topic, CASE WHEN kind = 'search' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM obs),
grid AS (SELECT topic, site, sess, dday, least(1.0::DOUBLE, sum(mass * weight)) AS mass FROM cells JOIN member USING (atom) GROUP BY ALL),
agg AS (SELECT topic, sum(mass * pow(2.0::DOUBLE, -{AGE} / 1.0::DOUBLE)) AS m1, sum(mass * pow(2.0::DOUBLE, -{AGE} / 7.0::DOUBLE)) AS m7, sum(mass * pow(2.0::DOUBLE, -{AGE} / 30.0::DOUBLE)) AS m30,
  count(DISTINCT sess) AS n_sessions, count(DISTINCT site) AS n_sites FROM grid GROUP BY topic)"""


def _membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten topics by item number; searches belong fully, visits by half."""
    obs = observations(spark, sf_dir).withColumn("atom", ingest.canonical_id())
    return obs.select("atom", (F.substring("title", 13, 10).cast("long") % 10).cast("string").alias("topic"), F.when(F.col("kind") == "search", F.lit(1.0)).otherwise(F.lit(0.5)).alias("mass")).distinct()


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return ingest.fold_activity(obs).join(obs.select(ingest.canonical_id().alias("atom"), "site").distinct(), "atom")


@query(f"""WITH {OBS}, {TOPICS} SELECT topic, round(m1, 6) AS m1, round(m7, 6) AS m7, round(m30, 6) AS m30,
  round((2.0::DOUBLE / count(*) OVER () + m1) / (2.0::DOUBLE + sum(m1) OVER ()), 6) AS share1, round((2.0::DOUBLE / count(*) OVER () + m7) / (2.0::DOUBLE + sum(m7) OVER ()), 6) AS share7,
  round((2.0::DOUBLE / count(*) OVER () + m30) / (2.0::DOUBLE + sum(m30) OVER ()), 6) AS share30,
  round(CASE WHEN m1 <= 0 AND m30 <= 0 THEN 0 ELSE ln((m1 * (1 - pow(2.0::DOUBLE, -1.0::DOUBLE)) + 0.01::DOUBLE) / (m30 * (1 - pow(2.0::DOUBLE, -1.0::DOUBLE / 30)) + 0.01::DOUBLE)) END, 6) AS burst,
  n_sessions, n_sites, n_sessions >= 2 AS candidate FROM agg""")
def topic_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed masses, smoothed shares and bursts of topics."""
    out = activity.topic_activity(_cells(spark, sf_dir), _membership(spark, sf_dir), as_of())
    return out.select("topic", *[r6(c).alias(c) for c in ("m1", "m7", "m30", "share1", "share7", "share30", "burst")], F.col("sessions").alias("n_sessions"), F.col("sites").alias("n_sites"), "candidate")


MEMORY = f"""items AS (SELECT {ATOM} AS atom, source, {TOPIC} AS t, kind, site, title, max(ts) AS last_seen FROM obs GROUP BY ALL),
win AS (SELECT DISTINCT {ATOM} AS atom, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS w FROM obs),
per AS (SELECT source || ':' || t AS topic, w, count(DISTINCT CASE WHEN kind = 'search' THEN atom END) AS searches, count(DISTINCT CASE WHEN kind <> 'search' THEN atom END) AS others FROM win JOIN items USING (atom) GROUP BY ALL),
rule AS (SELECT topic, count(*) AS n_sessions, bool_or(searches >= 1 AND others >= 2) AS coherent FROM per GROUP BY topic),
whole AS (SELECT source || ':' || t AS topic, count(*) AS evidence_count, count(DISTINCT site) AS n_sites, max(last_seen) AS last_seen,
  array_to_string(list_slice(list(atom ORDER BY last_seen DESC, atom), 1, 5), ',') AS shown, arg_min(title, struct_pack(o := -epoch_us(last_seen), a := atom)) AS memory_label FROM items GROUP BY ALL)"""


@query(f"""WITH {OBS}, {MEMORY} SELECT topic, memory_label, CAST(epoch_us(last_seen) AS BIGINT) AS last_us, n_sessions, n_sites, evidence_count, shown
FROM whole JOIN rule USING (topic) WHERE evidence_count >= 2 AND (n_sessions >= 2 OR coherent) ORDER BY last_us DESC, topic LIMIT 8""")
def dashboard_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest groups worth remembering, with label and newest items."""
    obs = observations(spark, sf_dir)
    records = ingest.fold_records(obs).withColumn("topic", F.concat("source", F.lit(":"), (F.substring("title", 13, 10).cast("long") % 10).cast("string")))
    items = feedback.effective(records, feedback.resolve(spark.createDataFrame([], "seq long, atom string, action string, text string, time timestamp")))
    windows = obs.select(ingest.canonical_id().alias("atom"), F.floor(F.unix_timestamp("observed_at") / 1800).alias("session"))
    out = dashboard.memories(dashboard.group_candidates(items), windows)
    return out.select("topic", F.col("label").alias("memory_label"), F.unix_micros("last_seen").alias("last_us"), F.col("sessions").alias("n_sessions"), F.col("sites").alias("n_sites"), "evidence_count", F.array_join(F.transform("items", lambda i: i.atom), ",").alias("shown"))


@query("""WITH t AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS prev, date_diff('microsecond', ts, lead(ts) OVER w) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
v AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS visit FROM t)
SELECT user_id, CAST(visit AS BIGINT) AS visit, any_value(event_type) AS event_type, round(least(3600.0::DOUBLE, sum(greatest(0.0::DOUBLE, least(65.0::DOUBLE, coalesce(gap, 0.0::DOUBLE))))), 6) AS secs_total FROM v GROUP BY user_id, visit""")
def dwell_from_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits by change of type, with clamped dwell."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = activity.dwell(e, "user_id", "at", ["event_type"])
    return out.select("user_id", F.col("visit").cast("long").alias("visit"), "event_type", r6("secs").alias("secs_total"))


@query(f"""WITH {OBS}, rec AS (SELECT {ATOM} AS atom, site, title, kind, max(ts) AS last_seen, least(3600, sum(dwell)) AS total, count(DISTINCT CAST(floor(epoch(ts) / 1800) AS BIGINT)) AS n_sessions FROM obs GROUP BY ALL)
SELECT atom, site, kind, CAST(epoch_us(last_seen) AS BIGINT) AS last_us, n_sessions, n_sessions >= 2 AND length(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) >= 7 AS prominent FROM rec ORDER BY last_us DESC, atom LIMIT 60""")
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest records as cards."""
    obs = observations(spark, sf_dir)
    sessions = ingest.fold_activity(obs).groupBy("atom").agg(F.countDistinct("session").alias("sessions"))
    records = ingest.fold_records(obs).join(sessions, "atom")
    eff = feedback.effective(records, feedback.resolve(spark.createDataFrame([], "seq long, atom string, action string, text string, time timestamp")))
    return dashboard.cards(eff).select("atom", "site", "kind", F.unix_micros("last_seen").alias("last_us"), F.col("sessions").alias("n_sessions"), "prominent")
