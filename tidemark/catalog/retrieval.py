"""Retrieval queries: BM25, coverage, literal lane, fusion, temporal order, arms, payloads, packets, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contract, text
from ..operators import evaluation, feedback, ingest, packet, search
from .base import ATOM, OBS, as_of, observations, query, r6, table
from .texts import TOK

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in text.STOP_FOLDED)
#: Questions: the whole text of every document whose id is divisible by 20; of their terms, as the engine takes them, the first 32.
ASK = f"""q0 AS (SELECT doc_id AS request_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {TOK.format("text")} AS t FROM documents WHERE doc_id % 20 = 0)),
q1 AS (SELECT request_id, term, min(i) AS i FROM q0 WHERE (length(term) >= 2 OR regexp_full_match(term, '[0-9]+')) AND term NOT IN ({STOP}) GROUP BY ALL),
q AS (SELECT request_id, list(term ORDER BY i) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i) AS rn FROM q1) WHERE rn <= 32 GROUP BY request_id)"""
BM25 = f"""{ASK}, d AS (SELECT doc_id AS doc, {TOK.format('text')} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)::DOUBLE) AS avgdl FROM d),
a AS (SELECT request_id, unnest(terms) AS term FROM q), f AS (SELECT doc, len(t) AS dl, unnest(t) AS term FROM d), tf AS (SELECT term, doc, dl, count(*)::DOUBLE AS tf FROM f SEMI JOIN a USING (term) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
sc AS (SELECT request_id, doc, sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM a JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, doc) AS rn FROM sc QUALIFY rn <= 64)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("request_id"), text.query_terms("text").alias("terms")).where("size(terms) > 0")


def _lexical(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    return search.bm25_best(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), "doc_id", "text", most)


@query(f"WITH {BM25} SELECT request_id, doc, rn AS place, round(score, 6) AS score FROM lex WHERE rn <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each question by BM25."""
    scored = _lexical(spark, sf_dir, 10)
    return search.channel(scored, 10, "lexical").join(scored, ["request_id", "doc"]).select("request_id", "doc", F.col("rank").cast("long").alias("place"), "score")


FORMS = r"""list_concat([x], CASE WHEN regexp_full_match(x, '\p{L}+') AND x LIKE '%s' AND length(x) >= 5 THEN [left(x, length(x) - 1)] ELSE [] END)"""


@query(f"""WITH {BM25}, p AS (SELECT request_id, doc, terms, t FROM lex JOIN q USING (request_id) JOIN d USING (doc) WHERE rn <= 20),
c AS (SELECT request_id, doc, len(terms) AS n, len(list_filter(terms, lambda y: list_has_any(list_transform([y], lambda x: x), flatten(list_transform(t, lambda x: {FORMS}))) OR list_has_any((list_transform([y], lambda x: {FORMS}))[1], flatten(list_transform(t, lambda x: {FORMS}))))) AS matched FROM p)
SELECT request_id, doc, CAST(matched AS BIGINT) AS matched, round(matched / n, 6) AS coverage, matched / n >= 0.5 AS admitted FROM c""")
def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each question its twenty best documents cover."""
    lex = search.channel(_lexical(spark, sf_dir, 20), 20, "lexical").select("request_id", "doc")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array_distinct(text.tokens("text")).alias("t"))
    held = docs.join(lex.select("doc").distinct(), "doc", "left_semi").select("doc", "t", text.held_forms("t").alias("held"))
    pairs = lex.join(_asked(spark, sf_dir), "request_id").join(held, "doc").select("request_id", "doc", text.coverage(F.col("terms"), F.col("t"), F.col("held")).alias("c"))
    return pairs.select("request_id", "doc", F.col("c.matched").cast("long").alias("matched"), r6("c.coverage").alias("coverage"), (F.col("c.coverage") >= 0.5).alias("admitted"))


@query("""WITH p AS (SELECT 1 AS request_id, 'heit' AS phrase UNION ALL SELECT 2, 'ción'), h AS (SELECT request_id, doc_id AS doc FROM documents, p WHERE contains(text, phrase))
SELECT request_id, doc, row_number() OVER (PARTITION BY request_id ORDER BY doc DESC) AS place FROM h QUALIFY place <= 64""")
def literal_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a phrase literally, the newest first. The phrases take the CJK lane's place here, since the tables hold no CJK text."""
    docs = table(spark, sf_dir, "documents")
    phrases = spark.createDataFrame([(1, "heit"), (2, "ción")], "request_id int, phrase string")
    hit = docs.join(F.broadcast(phrases), F.contains("text", "phrase")).select("request_id", F.col("doc_id").alias("doc"))
    rank = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("doc")))
    return hit.withColumn("place", rank.cast("long")).where("place <= 64")


FUSE = f"""{BM25}, sem AS (SELECT request_id, doc, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, doc) AS rn FROM (SELECT a.doc_id AS request_id, b.doc_id AS doc, abs(a.n_chars - b.n_chars) * -1 AS n FROM documents a JOIN documents b USING (lang, source) WHERE a.doc_id % 20 = 0) QUALIFY rn <= 64),
fus AS (SELECT request_id, doc, sum(1.0::DOUBLE / (60.0::DOUBLE + rn)) AS score FROM (SELECT request_id, doc, rn FROM lex UNION ALL SELECT request_id, doc, rn FROM sem) GROUP BY ALL)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.where("lang is not null and source is not null").select(F.col("doc_id").alias("doc"), "lang", "source", F.col("n_chars").alias("value"))
    other = search.closest(rows, rows.where("doc % 20 = 0").withColumnRenamed("doc", "request_id"), ["lang", "source"], 64)
    return search.fuse(search.channel(_lexical(spark, sf_dir, 64), 64, "lexical").unionByName(search.channel(other, 64, "semantic")))


@query(f"WITH {FUSE} SELECT request_id, doc, round(score, 6) AS score FROM fus")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of a lexical channel and one by likeness of length."""
    return _fused(spark, sf_dir).withColumn("score", r6("score"))


@query(f"""WITH {OBS}, rec AS (SELECT {ATOM} AS atom, source, max(ts) AS last_seen, count(DISTINCT CAST(floor(epoch(ts) / 1800) AS BIGINT)) AS n, row_number() OVER (PARTITION BY source ORDER BY {ATOM}) AS rn FROM obs GROUP BY source, site, kind, title)
SELECT atom, round(1.0::DOUBLE / (60 + rn) + (0.1::DOUBLE / 61) * (0.7::DOUBLE * pow(2.0::DOUBLE, -least(90.0::DOUBLE, greatest(0.0::DOUBLE, date_diff('second', last_seen, TIMESTAMP '2024-01-31 00:00:00') / 86400.0::DOUBLE)) / 14.0::DOUBLE) + 0.3::DOUBLE * ln(1.0::DOUBLE + least(n, 4)) / ln(5.0::DOUBLE)), 6) AS score FROM rec""")
def temporal_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the bounded bonus of recency and repetition."""
    obs = observations(spark, sf_dir)
    sessions = ingest.fold_activity(obs).groupBy("atom").agg(F.countDistinct("session").alias("sessions"))
    rec = ingest.fold_records(obs).join(sessions, "atom").withColumn("doc", F.col("atom"))
    ranked = rec.select(F.col("source").alias("request_id"), "doc", (1.0 / (60 + F.row_number().over(Window.partitionBy("source").orderBy("atom")))).alias("score"))
    out = search.rerank(ranked, rec.withColumn("last_seen", F.date_trunc("second", "last_seen")), as_of())
    return out.select(F.col("doc").alias("atom"), r6("score").alias("score"))


@query("""WITH r AS (SELECT lang, doc_id AS doc, 1 AS arm, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents UNION ALL SELECT lang, doc_id, 2, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) FROM documents WHERE n_chars > 500),
m AS (SELECT lang, doc, min(rn) AS best, bit_or(arm) AS arms FROM r WHERE rn <= 32 GROUP BY ALL) SELECT lang, doc, CAST(arms AS BIGINT) AS arms, row_number() OVER (PARTITION BY lang ORDER BY best, doc) AS place FROM m""")
def comparison_arm_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms' ranks merged: best rank, bits of the arms, ranked anew."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("doc"), "n_chars")
    one = search.channel(docs.withColumn("score", F.col("n_chars")), 32, "a", ["lang"]).withColumn("arm", F.lit(1))
    two = search.channel(docs.where("n_chars > 500").withColumn("score", -F.col("n_chars")), 32, "b", ["lang"]).withColumn("arm", F.lit(2))
    return search.merge_arms(one.unionByName(two), ["lang"]).select("lang", "doc", F.col("arms").cast("long").alias("arms"), F.col("rank").cast("long").alias("place"))


@query("""WITH r AS (SELECT doc_id AS doc, lang, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, CASE WHEN doc_id % 10 = 0 THEN 'confirmed' ELSE 'observed' END AS state FROM documents)
SELECT lang, doc, rn AS place, min(rn) OVER (PARTITION BY lang, title, state, CASE WHEN state = 'confirmed' THEN doc ELSE -1 END) AS group_place FROM r""")
def payload_group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rank among observed documents with one title; confirmed ones stay alone."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("doc"), F.col("text").alias("title"), F.when(F.col("doc_id") % 10 == 0, F.lit("confirmed")).otherwise(F.lit("observed")).alias("state"))
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("doc")))
    out = search.payload_groups(ranked, ["title", "state"], ["lang"])
    return out.select("lang", "doc", F.col("rank").cast("long").alias("place"), F.col("group_rank").cast("long").alias("group_place"))


@query("""WITH RECURSIVE d AS (SELECT lang, CAST(doc_id AS VARCHAR) AS atom, source, octet_length(encode(CAST(to_json({'text': text}) AS VARCHAR))) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
s AS (SELECT lang, 0::BIGINT AS rn, ''::VARCHAR AS atom, ''::VARCHAR AS source, FALSE AS taken, 64::BIGINT AS bytes, 0::BIGINT AS n_taken, []::VARCHAR[] AS sites FROM (SELECT DISTINCT lang FROM d)
  UNION ALL SELECT lang, rn, atom, source, ok, CASE WHEN ok THEN bytes ELSE before END, CASE WHEN ok THEN n_taken + 1 ELSE n_taken END, CASE WHEN ok THEN list_append(sites, source) ELSE sites END FROM (
    SELECT d.lang, d.rn, d.atom, d.source, s.bytes AS before, s.bytes + d.n + (s.n_taken > 0)::INT AS bytes, s.n_taken, s.sites, s.n_taken < 6 AND len(list_filter(s.sites, lambda x: x = d.source)) < 2 AND s.bytes + d.n + (s.n_taken > 0)::INT <= 16384 AS ok
    FROM s JOIN d ON d.lang = s.lang AND d.rn = s.rn + 1 WHERE d.rn <= 160))
SELECT lang AS request_id, n_taken - 1 AS position, atom, source AS site, bytes FROM s WHERE taken""")
def packet_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of a language's documents: at most six, two from a source, within the greatest number of bytes, from as many as the channels hold."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("request_id"), F.col("doc_id").cast("string").alias("atom"), F.col("source").alias("site"), F.to_json(F.struct("text")).alias("record"), "doc_id")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("doc_id"))).where("rank <= 160")
    rows = ranked.withColumns({"group_rank": F.col("rank"), "arms": F.lit(0), "all_arms": F.lit(0), "max_bytes": F.lit(16384)})
    return packet.select(rows).select("request_id", F.col("position").cast("long").alias("position"), "atom", "site", F.col("bytes").cast("long").alias("bytes"))


HISTORY = """f AS (SELECT doc_id * 3 AS seq, doc_id % 97 AS atom, CASE WHEN toxic = 1 THEN 'do_not_use' WHEN quality = 1 THEN 'confirm_constraint' ELSE 'temporary_research' END AS action, CASE WHEN doc_id % 5 <> 0 THEN 'text ' || doc_id END AS words FROM labels)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("toxic") == 1, F.lit("do_not_use")).when(F.col("quality") == 1, F.lit("confirm_constraint")).otherwise(F.lit("temporary_research"))
    return table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("seq"), (F.col("doc_id") % 97).alias("atom"), action.alias("action"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("text "), F.col("doc_id"))).alias("text"))


@query(f"""WITH {HISTORY}, l AS (SELECT atom, seq, words FROM f WHERE action = 'confirm_constraint' QUALIFY row_number() OVER (PARTITION BY atom ORDER BY seq DESC) = 1)
SELECT f.atom, bool_or(action = 'do_not_use') AS suppressed, bool_or(action <> 'confirm_constraint') AS excluded, any_value(l.seq) AS confirmed_seq, any_value(l.words) AS confirmed_text, string_agg(action, ',' ORDER BY f.seq) AS history FROM f LEFT JOIN l ON f.atom = l.atom GROUP BY f.atom""")
def feedback_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sticky flags, the latest confirmation by write order, and the history."""
    out = feedback.resolve(_history(spark, sf_dir))
    return out.select("atom", "suppressed", "excluded", "confirmed_seq", "confirmed_text", F.array_join(F.transform("history", lambda h: h.action), ",").alias("history"))


@query("""SELECT lang, count(*) AS n_docs FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY lang""")
def suppression_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no correction suppresses."""
    rows = table(spark, sf_dir, "documents").withColumn("atom", F.col("doc_id"))
    corrections = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("atom"), F.lit("do_not_use").alias("action"))
    return feedback.unsuppressed(rows, corrections).groupBy("lang").agg(F.count("*").alias("n_docs"))


EVAL = """res AS (SELECT doc_id % 40 AS query_id, doc_id AS doc, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE doc_id % 40 < 36), rel AS (SELECT doc_id % 40 AS query_id, doc_id AS doc FROM labels WHERE toxic = 1 AND doc_id % 40 < 38),
top AS (SELECT res.*, rel.doc IS NOT NULL AS ok FROM res LEFT JOIN rel USING (query_id, doc) WHERE rn <= 6), ex AS (SELECT query_id, count(*) AS expected FROM rel GROUP BY 1),
g AS (SELECT query_id, count(*) AS returned, count(*) FILTER (WHERE ok) AS hits, min(rn) FILTER (WHERE ok) AS first, coalesce(sum(1 / log2(rn + 1.0)) FILTER (WHERE ok), 0) AS dcg FROM top GROUP BY 1),
m AS (SELECT i AS query_id, coalesce(expected, 0) AS expected, coalesce(returned, 0) AS returned, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg FROM range(40) t(i) LEFT JOIN ex ON ex.query_id = i LEFT JOIN g ON g.query_id = i)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc")
    res = docs.where("doc_id % 40 < 36").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("doc"), "n_chars").withColumn("rank", F.row_number().over(order))
    rel = labels.where("toxic = 1 and doc_id % 40 < 38").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("doc"))
    return evaluation.metrics(res, rel, spark.range(40).select(F.col("id").alias("query_id")))


@query(f"""WITH {EVAL} SELECT query_id, round(CASE WHEN expected > 0 THEN hits / expected END, 6) AS recall, round(CASE WHEN expected > 0 THEN hits / 6.0 END::DOUBLE, 6) AS precision_cut, round(CASE WHEN expected > 0 THEN coalesce(1.0::DOUBLE / first, 0) END, 6) AS mrr,
round(CASE WHEN expected > 0 THEN dcg / list_sum(list_transform(range(1, greatest(1, least(expected, 6)) + 1), lambda r: 1 / log2(r + 1.0))) END, 6) AS ndcg, returned, expected FROM m""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, reciprocal rank and gain at six, for each question."""
    return _metrics(spark, sf_dir).select("query_id", r6("recall").alias("recall"), r6("precision").alias("precision_cut"), r6("mrr").alias("mrr"), r6("ndcg").alias("ndcg"), "returned", "expected")


@query(f"""WITH {EVAL} SELECT round(avg(hits / expected) FILTER (WHERE expected > 0), 6) AS macro_recall, round(avg(coalesce(1.0::DOUBLE / first, 0)) FILTER (WHERE expected > 0), 6) AS macro_mrr, round(avg((returned = 0)::INT) FILTER (WHERE expected = 0), 6) AS specificity FROM m""")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages, and specificity of questions that expect nothing."""
    return evaluation.summary(_metrics(spark, sf_dir)).select(r6("macro_recall").alias("macro_recall"), r6("macro_mrr").alias("macro_mrr"), r6("specificity").alias("specificity"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT *, round(tp / (tp + fp), 6) AS precision_share, round(tp / (tp + fn), 6) AS recall_share, round(tn / (tn + fp), 6) AS specificity FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and rates of one label as a prediction of the other."""
    c = evaluation.confusion(table(spark, sf_dir, "labels"), F.col("toxic") == 1, F.col("quality") == 0)
    return c.select("tp", "fp", "fn", "tn", r6("precision").alias("precision_share"), r6("recall").alias("recall_share"), r6("specificity").alias("specificity"))


@query("""WITH rel AS (SELECT doc_id % 40 AS query_id, doc_id AS doc FROM labels WHERE quality = 1)
SELECT query_id, doc, CASE WHEN doc % 11 = 0 THEN 'not_indexed' WHEN doc % 7 = 0 THEN 'ineligible' WHEN doc % 5 = 0 THEN 'not_retrieved' WHEN doc % 3 = 0 THEN 'not_admitted' WHEN doc % 2 = 0 THEN 'cut_by_rank' WHEN doc % 13 = 0 THEN 'not_selected' ELSE 'selected' END AS loss FROM rel""")
def stage_loss_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which stage each relevant document is lost."""
    rel = table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("doc"))
    at = dict(zip(("indexed", "eligible", "retrieved", "admitted", "ranked", "selected"), (11, 7, 5, 3, 2, 13)))
    stages = {name: (rel.select("doc") if name == "indexed" else rel).where(F.col("doc") % n != 0) for name, n in at.items()}
    return evaluation.stage_loss(rel, stages)


#: Records: a sentence for each order, with its model's name and price; every ninth is confirmed.
SOLD = """o AS (SELECT o_orderkey AS k, 'c' || (o_custkey % 50) || '.example.org' AS site, 'paid $' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.' || printf('%02d', o_orderkey % 100) || ' for model RX-' || (o_orderkey % 1000) || ' with order ' || o_orderkey AS title,
  o_orderkey % 80 AS age, o_orderkey % 9 = 0 AS confirmed, o_orderkey % 5 AS sessions FROM orders)"""


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.concat(F.lit("paid $"), F.format_string("%d.%02d", F.floor("o_totalprice").cast("long"), (k % 100).cast("int")), F.lit(" for model RX-"), (k % 1000).cast("string"), F.lit(" with order "), k.cast("string"))
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("atom"), F.lit("all").alias("source"), F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example.org")).alias("site"), F.lit("visit").alias("kind"), line.alias("title"), F.lit(None).cast("string").alias("query"),
        (as_of() - F.make_dt_interval((k % 80).cast("int"))).alias("last_seen"), F.when(k % 9 == 0, F.lit("confirmed")).otherwise(F.lit("observed")).alias("state"), line.alias("effective_text"),
        F.lit("unknown").alias("subject"), F.lit(False).alias("suppressed"), F.array().cast("array<string>").alias("corrections"), (k % 5).alias("sessions"),
    )


@query(f"""WITH {SOLD}, st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM (SELECT len({TOK.format("title")})::DOUBLE AS dl FROM o)), f AS (SELECT o.*, len({TOK.format("title")}) AS dl FROM o WHERE NOT (site = 'c7.example.org')),
p AS (SELECT q.k AS request_id, f.* FROM o q JOIN f ON f.k % 1000 = q.k % 1000 WHERE q.k % 20 = 0),
lex AS (SELECT request_id, k, row_number() OVER (PARTITION BY request_id ORDER BY 2.2::DOUBLE / (1.0::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) DESC, CAST(k AS VARCHAR)) AS r FROM p, st WHERE NOT confirmed QUALIFY r <= 64),
sem AS (SELECT request_id, k, row_number() OVER (PARTITION BY request_id ORDER BY CAST(k AS VARCHAR)) AS r FROM p WHERE NOT confirmed QUALIFY r <= 64),
con AS (SELECT request_id, k, row_number() OVER (PARTITION BY request_id ORDER BY CAST(k AS VARCHAR)) AS r FROM p WHERE confirmed QUALIFY r <= 32),
fu AS (SELECT request_id, k, sum(1.0::DOUBLE / (60.0::DOUBLE + r)) AS s FROM (SELECT * FROM lex UNION ALL SELECT * FROM sem UNION ALL SELECT * FROM con) GROUP BY ALL),
sc AS (SELECT p.request_id, p.k, site, row_number() OVER (PARTITION BY p.request_id ORDER BY s + (0.1::DOUBLE / 61) * (0.7::DOUBLE * pow(2.0::DOUBLE, -age / 14.0::DOUBLE) + 0.3::DOUBLE * ln(1.0::DOUBLE + least(sessions, 4)) / ln(5.0::DOUBLE)) DESC, CAST(p.k AS VARCHAR)) AS rank FROM p JOIN fu USING (request_id, k)),
two AS (SELECT *, row_number() OVER (PARTITION BY request_id, site ORDER BY rank) AS at_site FROM sc)
SELECT CAST(request_id AS VARCHAR) AS request_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) - 1 AS position, CAST(k AS VARCHAR) AS atom, site FROM two WHERE at_site <= 2 QUALIFY position < 6""")
def recall_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What did a model cost: packets for every order whose key is divisible by 20, over a record of each order, by all three channels.

    A record's vector is that of its key's remainder by 100, and so is a request's."""
    from ..plans.recall import recall

    records, vectors = _sold(spark, sf_dir), table(spark, sf_dir, "embeddings").select((F.col("vec_id")).alias("v"), F.col("embedding").cast("array<double>").alias("vector"))
    embedded = records.select("atom", (F.col("atom").cast("long") % 100).alias("v")).join(vectors, "v").select("atom", "vector")
    asked = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 100).alias("v")).join(vectors, "v")
    question = F.concat(F.lit("What did model RX-"), (F.col("k") % 1000).cast("string"), F.lit(" cost?"))
    requests = asked.select(F.col("k").cast("string").alias("request_id"), F.lit("all").alias("source"), question.alias("query"), F.array().cast("array<string>").alias("facets"), F.array(F.lit("projects"), F.lit("research"), F.lit("confirmed_preferences")).alias("scope"), F.lit(16384).alias("max_bytes"), "vector", F.lit(None).cast("array<double>").alias("agreement"))
    out = recall(requests, records, embedded, as_of(), ["c7.example.org"])
    return out.select("request_id", F.col("position").cast("long").alias("position"), "atom", "site")


@query("""WITH t AS (SELECT o_orderkey AS k, 'RX-' || (o_orderkey % 1000) AS m, 'identifier|rx' || (o_orderkey % 1000) AS i, CAST(o_orderkey % 90 + 1 AS VARCHAR) AS n, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT k, CASE k % 8 WHEN 0 THEN i WHEN 1 THEN i || ';quantity|' || n || ':gb' WHEN 2 THEN i || ';money|dollar-symbol:' || n WHEN 3 THEN '' WHEN 4 THEN 'version|v1.' || n || '.2;date|' || day WHEN 5 THEN i WHEN 6 THEN 'money|eur:' || n || ';' || i ELSE i END AS equal,
CASE k % 8 WHEN 3 THEN 'range|between ' || n || ' kg and 99 kg' WHEN 5 THEN 'range|over $' || n WHEN 7 THEN 'value| $' || n || ',00,0' ELSE '' END AS unsupported,
CASE k % 8 WHEN 0 THEN 'money' WHEN 1 THEN 'quantity:data' WHEN 2 THEN 'money' WHEN 5 THEN 'money' WHEN 6 THEN 'money' WHEN 7 THEN 'money' ELSE 'research' END AS answer, k % 8 IN (2, 6) AS confirm FROM t""")
def question_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions made from orders ask for: prices, quantities, decisions, ranges, malformed values."""
    o = table(spark, sf_dir, "orders")
    k, n, m = F.col("o_orderkey"), (F.col("o_orderkey") % 90 + 1).cast("string"), F.concat(F.lit("RX-"), (F.col("o_orderkey") % 1000).cast("string"))
    asked = [
        F.concat(F.lit("What did model "), m, F.lit(" cost?")), F.concat(F.lit("How much memory does "), m, F.lit(" have with "), n, F.lit(" GB?")), F.concat(F.lit("Which day did I book "), m, F.lit(" for $"), n, F.lit("?")),
        F.concat(F.lit("Which models weigh between "), n, F.lit(" kg and 99 kg?")), F.concat(F.lit("notes on v1."), n, F.lit(".2 from "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Is "), m, F.lit(" over $"), n, F.lit("?")),
        F.concat(F.lit("Have I paid "), n, F.lit(" EUR for "), m, F.lit("?")), F.concat(F.lit("Is "), m, F.lit(" at $"), n, F.lit(",00,0 now?")),
    ]
    question = F.coalesce(*[F.when(k % 8 == i, q) for i, q in enumerate(asked)])
    r = o.select(k.alias("k"), contract.requirements_of(question).alias("r"))
    return r.select("k", F.array_join("r.equal", ";").alias("equal"), F.array_join("r.unsupported", ";").alias("unsupported"), "r.answer", "r.confirm")
