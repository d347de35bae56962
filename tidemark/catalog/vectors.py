"""Vector queries: similarity, mixing, quantisation, centroids, greedy topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Defaults
from ..functions import vectors
from ..operators import search, topics
from .base import query, r6, table

UNIT = "(SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"


@query(f"""WITH u AS {UNIT}, s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc, list_inner_product(q.v, d.v) AS c FROM u q, u d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc) AS rn FROM s) SELECT query_id, doc, rn AS place, round(c, 6) AS cosine FROM r WHERE rn <= 64""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 nearest of all vectors to each vector whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"))
    scored = search.nearest(e, asked, "vec_id", "embedding", 64)
    ranked = search.channel(scored, 64, "semantic").join(scored, ["request_id", "doc"])
    return ranked.select(F.col("request_id").alias("query_id"), "doc", F.col("rank").cast("long").alias("place"), r6("cosine").alias("cosine"))


@query(f"""WITH u AS {UNIT}, p AS (SELECT a.vec_id, a.v AS t, b.v AS q FROM u a LEFT JOIN u b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 7 <> 0),
m AS (SELECT vec_id, CASE WHEN q IS NULL THEN t ELSE list_transform(list_zip(t, q), lambda x: 0.3::DOUBLE * x[1] + 0.7::DOUBLE * x[2]) END AS raw, q IS NULL AS alone FROM p)
SELECT vec_id, round(CASE WHEN alone THEN raw[1] ELSE raw[1] / sqrt(list_inner_product(raw, raw)) END, 6) AS first, round(list_sum(CASE WHEN alone THEN raw ELSE list_transform(raw, lambda x: x / sqrt(list_inner_product(raw, raw))) END), 6) AS total FROM m""")
def vector_mix_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and query vectors mixed 0.3 to 0.7; the title's alone where there is no query."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalize("embedding").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("q")).where("vec_id % 7 <> 0")
    m = e.join(nxt, "vec_id", "left").select("vec_id", vectors.mix("v", "q").alias("m"))
    return m.select("vec_id", r6(F.element_at("m", 1)).alias("first"), r6(F.aggregate("m", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e),
q AS (SELECT vec_id, v, scale, list_transform(v, lambda x: round_even(x / scale, 0)) AS q FROM s)
SELECT vec_id, round(scale, 6) AS scale, CAST(list_sum(list_transform(q, lambda x: abs(x))) AS BIGINT) AS sum_abs, round(list_inner_product(q, v) / sqrt(list_inner_product(q, q) * list_inner_product(v, v)), 6) AS fidelity FROM q""")
def int8_quantise_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-bit quantisation of vectors and its cosine with the original."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("z", vectors.quantize("v"))
    total = F.aggregate("z.q", F.lit(0).cast("long"), lambda s, x: s + F.abs(x))
    return e.select("vec_id", r6("z.scale").alias("scale"), total.alias("sum_abs"), r6(vectors.cosine(F.col("z.q"), F.col("v"))).alias("fidelity"))


@query("""WITH w AS (SELECT CAST(vec_id % 5 AS VARCHAR) AS topic, CAST(label AS VARCHAR) AS site, CAST(vec_id % 3 AS VARCHAR) AS sess, CASE WHEN vec_id % 2 = 0 THEN 0.75::DOUBLE ELSE 0.4::DOUBLE END AS mass,
  list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
f AS (SELECT topic, site, sess, mass, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM w), c AS (SELECT topic, site, sess, i, sum(mass) AS m, sum(mass * x) AS s FROM f GROUP BY ALL),
t AS (SELECT topic, i, sum(s * least(m, 1.0::DOUBLE) / m) AS s FROM c GROUP BY ALL), n AS (SELECT topic, sqrt(sum(s * s)) AS len FROM t GROUP BY topic)
SELECT topic, i AS dim, round(s / len, 6) AS x FROM t JOIN n USING (topic)""")
def centroid_capped_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of five groups, each place and window capped at a mass of 1."""
    e = table(spark, sf_dir, "embeddings").withColumn("atom", F.col("vec_id").cast("string"))
    membership = e.select("atom", (F.col("vec_id") % 5).cast("string").alias("topic"), F.lit(1.0).alias("mass"))
    activity = e.select("atom", F.col("label").cast("string").alias("site"), (F.col("vec_id") % 3).cast("string").alias("session"), F.when(F.col("vec_id") % 2 == 0, F.lit(0.75)).otherwise(F.lit(0.4)).alias("mass"))
    out = topics.centroids(membership, activity, e.select("atom", F.col("embedding").alias("vector")))
    return out.select("topic", F.posexplode("centroid").alias("p", "v")).select("topic", (F.col("p") + 1).cast("long").alias("dim"), r6("v").alias("x"))


@query()
def greedy_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy topics of each label's vectors as a vault, in the order of ids, at thresholds that suit random vectors."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("label").cast("string").alias("vault"), F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("atom"), F.col("vec_id").alias("first_seen"), F.lit("s").alias("site"), (F.col("vec_id") % 4).cast("string").alias("session"), F.lit(0.75).alias("mass"), F.col("embedding").cast("array<double>").alias("vector"))
    return topics.assign(rows, "m", Defaults(topic_admission=0.3, runner_up_admission=0.25, max_topics=16))
