"""Sources: event batches, labelled retrieval sets, vector packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT


def events(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Captured events of a closed schema. An event with a field that is not in the schema is refused as malformed."""
    if form != "json":
        return spark.read.schema(EVENT).format(form).load(path)
    known = [x.split()[0] for x in EVENT.split(", ")]
    raw = spark.read.text(path)
    parsed = raw.select("value", F.from_json("value", EVENT, {"mode": "PERMISSIVE"}).alias("e"), F.json_object_keys("value").alias("keys"))
    fine = F.size(F.array_except("keys", F.array(*[F.lit(k) for k in known]))) == 0
    return parsed.where(F.coalesce(fine, F.lit(False))).select("e.*")


def recent(records: DataFrame, source: str, cutoff: Column, most: int = 10_000) -> DataFrame:
    """A source's records since a time, newest first: a filter at the scan and a top-k, no full sort."""
    return records.where((F.col("source") == source) & (F.col("last_seen") >= cutoff)).orderBy(F.desc("last_seen"), "atom").limit(most)


def judged_set(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A labelled retrieval set: corpus, queries and a complete query-by-document matrix of judgements (0, 1 or 2)."""
    read = lambda name, kind: spark.read.schema(kind).json(f"{folder}/{name}.jsonl")
    out = {"corpus": read("corpus", "doc_id string, title string, site_key string"), "queries": read("queries", "query_id string, text string"), "qrels": read("qrels", "query_id string, doc_id string, relevance int")}
    want = out["queries"].count() * out["corpus"].count()
    got = out["qrels"].where("relevance between 0 and 2").join(out["corpus"], "doc_id", "left_semi").join(out["queries"], "query_id", "left_semi").select("query_id", "doc_id").distinct().count()
    if got != want or out["qrels"].count() != want:
        raise ValueError(f"the judgements are not a full matrix: {got} of {want}")
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, for comparison with a manifest."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def vectors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(atom, model, vector); the model filter reaches the scan."""
    df = spark.read.parquet(path)
    return df if model is None else df.where(F.col("model") == model)
