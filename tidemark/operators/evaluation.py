"""Quality of ranked results against judged relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = 6


def metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, cut: int = CUT) -> DataFrame:
    """(query_id, recall, precision, precision_returned, mrr, ndcg, returned, expected) with ``cut`` results.

    results (query_id, doc, rank), relevant (query_id, doc). Precision divides by the cut, precision_returned by what
    came back."""
    judged = relevant.select("query_id", "doc").distinct().withColumn("rel", F.lit(1))
    top = results.where(F.col("rank") <= cut).groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    hit = top.join(judged, ["query_id", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = hit.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(F.lit(0.0))).alias("dcg"))
    expected = judged.groupBy("query_id").agg(F.count("*").alias("expected"))
    rows = queries.select("query_id").distinct().join(expected, "query_id", "left").join(got, "query_id", "left").na.fill(0, ["expected", "returned", "hits"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("expected"), F.lit(cut))).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    some = F.col("expected") > 0
    return rows.select(
        "query_id", F.when(some, F.col("hits") / F.col("expected")).alias("recall"), F.when(some, F.col("hits") / F.lit(float(cut))).alias("precision"),
        F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")).alias("precision_returned"), F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(some, F.col("dcg") / ideal).alias("ndcg"), "returned", "expected",
    )


def summary(scores: DataFrame, percentiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Macro averages over queries with relevant documents; specificity over those that expect none; nearest-rank percentiles of recall."""
    none = F.col("expected") == 0
    return scores.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("recall", "precision", "mrr", "ndcg")],
        F.avg(F.when(none, (F.col("returned") == 0).cast("double"))).alias("specificity"),
        *[F.expr(f"percentile_disc({p}) within group (order by recall)").alias(f"recall_p{round(p * 100)}") for p in percentiles],
    )


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and specificity of a yes/no rule."""
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return c.select("tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"))


#: Stages that a judged document can be lost at, in the order they are asked.
STAGES = ("not_indexed", "ineligible", "not_retrieved", "not_admitted", "cut_by_rank", "not_selected", "selected")


def stage_loss(relevant: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, doc, loss): the first stage that a relevant document did not reach.

    stages: indexed (doc), then eligible, retrieved, admitted, ranked, selected (query_id, doc)."""
    out = relevant.select("query_id", "doc").distinct()
    marks = []
    for name in ("indexed", "eligible", "retrieved", "admitted", "ranked", "selected"):
        keys = ["doc"] if "query_id" not in stages[name].columns else ["query_id", "doc"]
        out = out.join(stages[name].select(*keys).distinct().withColumn(f"_{name}", F.lit(True)), keys, "left")
        marks.append(F.col(f"_{name}").isNull())
    return out.select("query_id", "doc", F.coalesce(*[F.when(m, F.lit(s)) for m, s in zip(marks, STAGES)], F.lit("selected")).alias("loss"))


def outcome(expected: Column, returned: Column) -> Column:
    """exact, partial, miss, unexpected or correct_empty, from two sets of ids."""
    hits = F.size(F.array_intersect(expected, returned))
    return (
        F.when((F.size(expected) == 0) & (F.size(returned) == 0), F.lit("correct_empty")).when(F.size(expected) == 0, F.lit("unexpected"))
        .when(hits == 0, F.lit("miss")).when((hits == F.size(expected)) & (hits == F.size(returned)), F.lit("exact")).otherwise(F.lit("partial"))
    )


def packet_checks(packets: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case: useful found, forbidden returned, useful groups touched, duplicate slots.

    packets (case_id, ids array), cases (case_id, useful, forbidden, groups array of arrays, minimum)."""
    rows = cases.join(packets, "case_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    touched = F.size(F.filter("groups", lambda g: F.arrays_overlap(g, F.col("ids"))))
    return rows.select(
        "case_id", F.size(F.array_intersect("useful", "ids")).alias("useful_found"), F.size(F.array_intersect("forbidden", "ids")).alias("forbidden_found"), touched.alias("groups_found"),
        (touched >= F.col("minimum")).alias("enough"), (F.size("ids") - F.size(F.array_distinct("ids"))).alias("duplicates"),
    )


def shift_to(rows: DataFrame, time: str, newest: Column) -> DataFrame:
    """rows moved in time so that the newest one is at ``newest``."""
    top = rows.agg(F.max(time).alias("_top"))
    moved = rows.crossJoin(F.broadcast(top))  # one row
    return moved.withColumn(time, F.timestamp_micros(F.unix_micros(time) + F.unix_micros(newest) - F.unix_micros("_top"))).drop("_top")
