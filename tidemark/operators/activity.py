"""Activity over time: decayed masses, smoothed shares, burst scores, dwell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Defaults


def decay(age_days: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / F.lit(half_life))


def age_days(day: str, as_of: Column) -> Column:
    """Whole days, at least 0."""
    return F.greatest(F.datediff(F.to_date(as_of), F.col(day)), F.lit(0)).cast("double")


def decayed(masses: DataFrame, keys: list[str], as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """(keys, m<h> for each half-life): masses are (keys, day, mass)."""
    age = age_days("day", as_of)
    return masses.groupBy(*keys).agg(*[F.sum(F.col("mass") * decay(age, h)).alias(f"m{h:g}") for h in d.half_lives])


def capped(activity: DataFrame, membership: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """(topic, site, session, day, mass): what a topic's members add up to in one place, window and day, at most 1."""
    joined = activity.join(membership.withColumnRenamed("mass", "weight"), "atom")
    return joined.groupBy("topic", "site", "session", "day").agg(F.least(F.lit(1.0), F.sum(F.col("mass") * F.col("weight"))).alias("mass"))


def daily_rate(mass: Column, half_life: float) -> Column:
    return mass * (1.0 - 2.0 ** (-1.0 / half_life))


def burst(short: Column, long: Column, d: Defaults = DEFAULTS) -> Column:
    """Log ratio of the daily rates of the shortest and the longest half-life; 0 without activity."""
    a, b = daily_rate(short, d.half_lives[0]), daily_rate(long, d.half_lives[-1])
    return F.when((short <= 0) & (long <= 0), F.lit(0.0)).otherwise(F.ln((a + d.burst_prior) / (b + d.burst_prior)))


def topic_activity(activity: DataFrame, membership: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """For each topic: decayed masses, smoothed shares of all activity, burst, distinct sessions and sites, candidate."""
    cells = capped(activity, membership, d)
    masses = decayed(cells, ["topic"], as_of, d)
    spread = cells.groupBy("topic").agg(F.countDistinct("session").alias("sessions"), F.countDistinct("site").alias("sites"))
    topics = masses.join(spread, "topic")
    names = [f"m{h:g}" for h in d.half_lives]
    totals = topics.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"t_{c}") for c in names])
    out = topics.crossJoin(F.broadcast(totals))  # one row
    prior = F.lit(d.share_prior)
    return out.select(
        "topic", *names,
        *[((prior / F.col("n") + F.col(c)) / (prior + F.col(f"t_{c}"))).alias(f"share{c[1:]}") for c in names],
        burst(F.col(names[0]), F.col(names[-1]), d).alias("burst"), "sessions", "sites", (F.col("sessions") >= 2).alias("candidate"),
    )


def dwell(events: DataFrame, key: str, time: str, identity: list[str], most: float = 65.0, cap: float = 3600.0) -> DataFrame:
    """Visits by change of identity, with foreground seconds: gaps to the next tick clamped to [0, most], capped in sum."""
    order = Window.partitionBy(key).orderBy(time, *identity)
    same = F.lit(True)
    for c in identity:
        same = same & F.lag(c).over(order).eqNullSafe(F.col(c))
    gap = F.unix_micros(F.lead(time).over(order)) - F.unix_micros(time)
    ticks = events.withColumns({"new": (~F.coalesce(same, F.lit(False)) | F.lag(time).over(order).isNull()).cast("int"), "delta": F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(gap / 1e6, F.lit(0.0))))})
    visits = ticks.withColumn("visit", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return visits.groupBy(key, "visit").agg(*[F.first(c).alias(c) for c in identity], F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.least(F.lit(cap), F.sum("delta")).alias("secs"))


def retained(kind: Column, secs: Column, d: Defaults = DEFAULTS) -> Column:
    return (kind == "search") | (secs >= d.min_visit_seconds)
