"""Semi-joins and set operations over the second fact model: customers as sources, orders as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import dashboard, ingest, packet, topics
from ..sources import sinks
from .base import query, table


@query("""SELECT o_orderstatus, count(*) AS n_orders FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey AND p.p_size < 10) GROUP BY o_orderstatus""")
def topic_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have at least one member in a join of two others."""
    small = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "part").where("p_size < 10").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(small, orders.o_orderkey == small.l_orderkey, "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))


@query("""WITH c AS (SELECT o_custkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT count(*) AS n, count(*) FILTER (WHERE id % 2 = 0) AS n_even FROM c""")
def channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct candidates of two channels."""
    a = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return a.unionByName(b).distinct().agg(F.count("*").alias("n"), F.count_if(F.col("id") % 2 == 0).alias("n_even"))


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS latest, count(*) AS n FROM orders GROUP BY o_custkey""")
def latest_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's latest event, without a sort of its events."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.count("*").alias("n"))


@query("""SELECT o_custkey AS source, count(*) FILTER (WHERE o_orderstatus = 'F') AS evidence, count(*) FILTER (WHERE o_orderstatus <> 'F') AS privacy FROM orders GROUP BY o_custkey""")
def generation_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot counters of each source from its log of changes."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.when(F.col("o_orderstatus") == "F", F.lit("evidence")).otherwise(F.lit("privacy")).alias("kind"))
    return ingest.generation(log)


@query("""SELECT l_partkey AS atom, arg_min(CAST(l_suppkey AS VARCHAR), struct_pack(m := -mass, t := CAST(l_suppkey AS VARCHAR))) AS topic FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS mass FROM lineitem GROUP BY ALL) GROUP BY l_partkey""")
def top_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest group of each record, ties by name."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("atom"), F.col("l_suppkey").cast("string").alias("topic")).agg(F.sum("l_quantity").alias("mass"))
    return topics.top_topic(m)


@query("""SELECT o_orderkey AS request_id, len(from_json(CASE WHEN o_orderkey % 5 = 0 THEN '[]' ELSE '["a","b"]' END, '["VARCHAR"]')) AS n_ids FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def newest_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred receipts with their lists decoded; a missing list is empty."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 5 != 0, F.lit('["a","b"]')).alias("ids"), F.col("o_orderdate").alias("time"))
    return sinks.newest_receipts(rows).select("request_id", F.size("ids").cast("long").alias("n_ids"))


@query("""WITH c AS (SELECT c_custkey, c_name || ' ' || c_mktsegment AS words, c_acctbal FROM customer) SELECT c_custkey AS atom, c_acctbal >= 0 AS prominent FROM c WHERE lower(words) LIKE '%building%' ORDER BY c_custkey""")
def client_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that contain a word in any case."""
    cards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("atom"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"), F.lit("").alias("site"), F.lit("observed").alias("state"), (F.col("c_acctbal") >= 0).alias("prominent"))
    return dashboard.client_filter(cards, "observed", "BuilDing").select("atom", "prominent")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderstatus <> 'P')
SELECT o_custkey AS request_id, o_orderkey AS atom FROM r WHERE pos <= 6 AND upto <= 30""")
def explain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by id in the caller's order until the byte budget ends."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    ids = rows.select(F.col("o_custkey").alias("request_id"), (F.row_number().over(order) - 1).alias("position"), F.col("o_orderkey").alias("atom"))
    records = rows.select(F.col("o_orderkey").alias("atom"), F.col("o_orderpriority").alias("record"))
    return packet.explain(ids, records, F.lit(True), 30).select("request_id", "atom")
