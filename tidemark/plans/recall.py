"""From a question to a plan, and from a plan to a packet.

``plan`` reads one question on the driver and returns a frozen description of what counts as evidence. ``recall`` turns
plans into one lazily composed DataFrame: eligibility before ranks, three channels, fusion, temporal order, direction,
payload groups, packet. Questions with a range or a malformed value get no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULTS, Defaults
from ..functions import contract, sites, text
from ..operators import packet, search
from ..schema import SCOPES
from ..tables import stage


class InvalidRequest(ValueError):
    pass


@dataclass(frozen=True)
class Request:
    request_id: str
    source: str
    query: str
    facets: tuple[str, ...] = ()
    scope: tuple[str, ...] = ("projects", "research", "confirmed_preferences")
    max_bytes: int = 4096
    vector: tuple[float, ...] | None = None
    facet_vectors: tuple[tuple[float, ...], ...] = ()
    agreement: tuple[float | None, ...] = ()

    def validate(self) -> None:
        if len(self.query) > 512 or len(self.facets) > 3 or any(len(f) > 128 for f in self.facets) or not 512 <= self.max_bytes <= 16384 or set(self.scope) - set(SCOPES):
            raise InvalidRequest("request is outside its limits")


@dataclass(frozen=True)
class RecallPlan:
    request: Request
    arm: int
    all_arms: int
    text: str
    equal: tuple[tuple[str, str], ...]
    unsupported: bool
    answer: str
    confirm: bool
    acronyms: tuple[str, ...]
    facets: tuple[str, ...]
    direction: contract.Direction | None


def plan(request: Request) -> list[RecallPlan]:
    """One plan, or one for each arm of a comparison."""
    request.validate()
    arms = contract.comparison(request.query)
    whole = contract.requirements(" ".join((request.query, *request.facets)))
    out = []
    for k, question in enumerate(arms or (request.query,)):
        facets = () if arms else request.facets
        needs = contract.requirements(" ".join((question, *facets)))
        out.append(RecallPlan(
            request, 1 << k if arms else 0, 3 if arms else 0, question, needs.equal, bool(whole.unsupported or needs.unsupported), contract.answer_type(question),
            contract.needs_confirmation(question), tuple(contract.acronyms(question)), tuple(contract.exact_facets(list(facets), list(request.agreement) or None)), contract.direction(request.query),
        ))
    return out


REQUEST = "request_id string, source string, query string, facets array<string>, scope array<string>, max_bytes int, vector array<double>, agreement array<double>"
PLAN = "plan_id string, request_id string, source string, arm int, all_arms int, main string, wide string, unsupported boolean, answer string, confirm boolean, acronyms array<string>, facets array<string>, equal array<string>, question string, max_bytes int, scope array<string>, vector array<double>, way_source string, way_target string"


def requests_frame(spark: SparkSession, requests: list[Request]) -> DataFrame:
    for r in requests:
        r.validate()
    rows = [(r.request_id, r.source, r.query, list(r.facets), list(r.scope), r.max_bytes, list(r.vector) if r.vector else None, list(r.agreement) or None) for r in requests]
    return spark.createDataFrame(rows, REQUEST)


def plans_frame(requests: DataFrame) -> DataFrame:
    """Plans of a table of requests (``REQUEST``), a row for each arm, with terms made by the corpus's tokeniser. The questions
    are read in Arrow batches on the executors. Requests outside their limits get no plan."""
    within = (F.char_length("query") <= 512) & (F.size("facets") <= 3) & F.forall("facets", lambda f: F.char_length(f) <= 128) & F.col("max_bytes").between(512, 16384) & (F.size(F.array_except("scope", F.array(*[F.lit(x) for x in SCOPES]))) == 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLAN.split(", ")]
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                agreed = () if r.agreement is None else tuple(None if x != x else x for x in r.agreement)
                for p in plan(Request(r.request_id, r.source, r.query, tuple(r.facets), tuple(r.scope), int(r.max_bytes), agreement=agreed)):
                    wide = " ".join(contract.canonical_identifiers(x) for x in (p.text, *p.facets))
                    way = p.direction
                    rows.append((f"{r.request_id}#{p.arm}", r.request_id, r.source, p.arm, p.all_arms, contract.canonical_identifiers(p.text), wide, p.unsupported, p.answer, p.confirm, list(p.acronyms), list(p.facets),
                                 [f"{k}|{v}" for k, v in p.equal], r.query, r.max_bytes, r.scope, r.vector, way.source if way else None, way.target if way else None))
            yield pd.DataFrame(rows, columns=names)

    df = requests.where(within).select(*[c.split()[0] for c in REQUEST.split(", ")]).mapInPandas(run, PLAN)
    return df.withColumns({"main_terms": text.query_terms("main"), "terms": text.query_terms("wide")})


def told_apart(requests: DataFrame) -> DataFrame:
    """requests with ``same``, a digest of all but their ids: requests that agree in it have the same packet."""
    rest = [c.split()[0] for c in REQUEST.split(", ")][1:]
    return requests.withColumn("same", F.sha2(F.to_json(F.struct(*rest)), 256))


def evidence_values(body: Column | str, keys: Broadcast[frozenset[str]] | None = None) -> Column:
    """Equality values that an evidence text holds, as 'kind|value'; and 'answer|type' for money and each quantity family.
    ``keys``: only texts that may hold one of these are read in full, the others give null."""
    kinds = None if keys is None else sorted({k.partition("|")[0] for k in keys.value})

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def held(t: str | None) -> list[str] | None:
            if kinds is not None and not contract.may_hold(t, keys.value, kinds):
                return None
            found = contract.spans(t)
            out = {f"{x.kind}|{x.normalized}" for x in found}
            out |= {"answer|money" for x in found if x.kind == "money"}
            out |= {f"answer|quantity:{f}" for x in found if x.kind == "quantity" and (f := contract.FAMILY_OF_UNIT.get(x.normalized.rpartition(':')[2]))}
            out |= {f"direction|{d.source}|{d.target}" for d in [contract.direction(t or "")] if d}
            return sorted(out)

        return pd.Series([held(t) for t in s], dtype=object)

    return run.asNondeterministic()(body)  # so that no filter on the values takes them twice


def evidence(records: DataFrame, as_of: Column, d: Defaults = DEFAULTS, keys: Broadcast[frozenset[str]] | None = None) -> DataFrame:
    """records (effective rows with ``sessions``) with what the checks need. Typed values come from one Arrow pass, which does
    not depend on the requests unless ``keys`` are given: then only records that may hold one of these values are returned."""
    whole = F.concat_ws(" ", "title", "query")
    body = F.when(F.col("state") == "confirmed", F.col("effective_text")).otherwise(whole)
    retained = (F.col("state") == "confirmed") | (F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(d.retention_days)))
    tokens = text.tokens(body)
    rows = records.where(retained & ~F.col("suppressed")).withColumn("values", evidence_values(body, keys))
    return rows.where("values is not null").withColumns({
        "body": body, "raw": text.compact("effective_text"), "held": text.compact(F.concat_ws(" ", "site", body)), "content": tokens,
        "plain": (F.col("query").isNull() & text.generic_title("title")) | (F.col("query").isNotNull() & ~text.groupable("title", "query")),
    }).withColumn("content", F.array_union("content", F.transform(F.filter("values", lambda v: v.startswith("identifier|")), lambda v: F.substring(v, F.lit(12), F.length(v)))))


def checked() -> Column:
    """Whether evidence passes every hard check of a plan; over columns of both."""
    observed = F.col("state") == "observed"
    scope = F.when(observed, F.arrays_overlap("scope", F.array(F.lit("research"), F.lit("projects")))).otherwise(F.array_contains("scope", "confirmed_preferences"))
    exact = F.size(F.array_except("equal", "values")) == 0
    answer = (F.col("answer") == "research") | F.array_contains("values", F.concat(F.lit("answer|"), F.col("answer")))
    named = F.forall("acronyms", lambda a: F.contains(F.when(observed, F.col("held")).otherwise(F.col("raw")), a))
    bare = F.lower("question").rlike("|".join(contract.EXPLAIN_PHRASES)) & (F.size(F.filter("values", lambda v: ~v.startswith("answer|") & ~v.startswith("direction|"))) == 1) & F.exists("values", lambda v: v.endswith(F.concat(F.lit("|"), F.col("raw"))))
    useless = observed & (F.col("confirm") | (F.col("plain") & ~F.exists("values", lambda v: ~v.startswith("answer|") & ~v.startswith("direction|")))) | (observed & F.col("query").isNull() & text.generic_title("title"))
    return scope & exact & answer & named & ~bare & ~useless


#: Equality values that are sent to the tasks, which then read only records that may hold one; if there are more, all are read.
KEYS_AT_MOST = 100_000


def recall(requests: list[Request] | DataFrame, records: DataFrame, embedded: DataFrame | None, as_of: Column, excluded: list[str] | None = None, d: Defaults = DEFAULTS) -> DataFrame:
    """Packets of a batch of requests: a list, or a table (``REQUEST``). records: effective rows with ``sessions``; embedded:
    (atom, vector).

    A plan with equality values meets, by the first of them, only records that hold it; a plan without any meets what the
    channels propose by equi-joins on terms, by similarity and among confirmed records. Only these are joined with evidence
    and plans for the hard checks. Evidence and plans are written once; without plans of the second sort only records that may
    hold a first value are evidence. Requests that differ in nothing but their ids are answered once. Excluded sites and
    retention are filters on the records' columns, so they reach the scan."""
    if not isinstance(requests, DataFrame):
        requests = requests_frame(records.sparkSession, requests)
    asked = told_apart(requests)
    plans = stage(plans_frame(asked.withColumn("request_id", F.col("same")).drop("same").distinct()).where("not unsupported and size(main_terms) > 0"), "plans")
    keyed, free = plans.where("size(equal) > 0"), plans.where("size(equal) = 0")
    keys = None
    if not free.limit(1).count():
        firsts = [r.key for r in keyed.select(F.element_at("equal", 1).alias("key")).distinct().limit(KEYS_AT_MOST + 1).collect()]
        keys = records.sparkSession.sparkContext.broadcast(frozenset(firsts)) if len(firsts) <= KEYS_AT_MOST else None
    rows = stage(evidence(records.where(sites.site_policy("site", excluded or [])), as_of, d, keys).withColumn("forms", text.held_forms("content")), "evidence")
    own = rows.withColumnRenamed("source", "r_source")
    met = own.withColumn("key", F.explode("values")).join(keyed.withColumn("key", F.element_at("equal", 1)), "key").where("r_source = source").drop("key")
    only = met.where("state = 'observed'").select(F.col("plan_id").alias("request_id"), F.col("atom").alias("doc")).distinct()
    only = stage(only, "met") if keyed.limit(1).count() else only

    def proposed(some: DataFrame, only: DataFrame | None) -> DataFrame:
        """(plan_id, atom, bm25, cosine); corpus statistics are over all records, before any filter."""
        asked = some.select(F.col("plan_id").alias("request_id"), F.col("terms"))
        lexical = search.bm25(records.withColumn("fts", F.concat_ws(" ", "title", "query")), asked, "atom", "fts", d, only).select(F.col("request_id").alias("plan_id"), F.col("doc").alias("atom"), F.col("score").alias("bm25"))
        if embedded is None:
            return lexical.withColumn("cosine", F.lit(None).cast("double"))
        wanted = some.where("vector is not null").select(F.col("plan_id").alias("request_id"), "vector")
        cos = search.cosine_scores(embedded, wanted, "atom", "vector", None, d, only).where(F.col("cosine") >= d.semantic_admission).select(F.col("request_id").alias("plan_id"), F.col("doc").alias("atom"), "cosine")
        return lexical.join(cos, ["plan_id", "atom"], "full")

    sides = [f() for some, f in ((keyed, lambda: proposed(keyed, only)), (free, lambda: proposed(free, None))) if some.limit(1).count()]
    pairs = sides[0].unionByName(sides[1]) if len(sides) == 2 else sides[0] if sides else proposed(free, None)
    observed_pairs = pairs.join(own.where("state = 'observed'"), "atom").join(plans, "plan_id").where("r_source = source")
    confirmed_pairs = met.unionByName(own.join(free, F.col("r_source") == F.col("source"))).where("state = 'confirmed'").withColumns({"bm25": F.lit(None).cast("double"), "cosine": F.lit(None).cast("double")})
    pool = observed_pairs.unionByName(confirmed_pairs).where(checked()).withColumn("cover", text.coverage(F.col("main_terms"), F.col("content"), F.col("forms")))
    facet = F.exists("facets", lambda f: (F.length(text.compact(f)) >= 3) & F.contains(F.col("raw"), text.compact(f)))
    good = search.admitted(F.col("bm25").isNotNull(), F.col("cover.coverage"), F.col("cosine"), facet, F.size("main_terms") > 0, d)
    observed, confirmed = pool.where("state = 'observed'").where(good), pool.where("state = 'confirmed'").where((F.col("cover.matched") > 0) & (F.col("cover.coverage") >= d.lexical_coverage))
    share = F.when(F.col("all_arms") > 0, F.lit(2)).otherwise(F.lit(1))

    def lane(df: DataFrame, score: Column, most: int, name: str) -> DataFrame:
        order = Window.partitionBy("plan_id").orderBy(F.desc("score"), "atom")
        return df.withColumn("score", score).where("score is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.lit(most) / share).select("request_id", "atom", "arm", "r", F.lit(name).alias("channel"))

    lanes = lane(observed, F.col("bm25"), d.channel_candidates, "lexical").unionByName(lane(observed.where(F.col("cosine") >= d.semantic_admission), F.col("cosine"), d.channel_candidates, "semantic")).unionByName(lane(confirmed, F.col("cover.matched").cast("double"), d.confirmed_candidates, "confirmed"))
    merged = lanes.groupBy("request_id", "channel", "atom").agg(F.min("r").alias("best"), F.bit_or("arm").alias("arms"))
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("request_id", "channel").orderBy("best", "atom")))
    fused = ranked.groupBy("request_id", "atom").agg(F.sum(1.0 / (F.lit(float(d.rrf_offset)) + F.col("rank"))).alias("score"), F.bit_or("arms").alias("arms"))
    ways = plans.select("request_id", "max_bytes", "all_arms", "way_source", "way_target").distinct()  # the arms of a request agree in these
    full = fused.join(rows.drop("source"), "atom").join(ways, "request_id")
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("last_seen")) / F.lit(86400.0)
    full = full.withColumn("score", F.col("score") + search.temporal_bonus(age, F.col("sessions"), d))
    way = lambda a, b: F.coalesce(F.array_contains("values", F.concat(F.lit("direction|"), a, F.lit("|"), b)), F.lit(False))
    relation = F.when(way(F.col("way_source"), F.col("way_target")), 0).when(way(F.col("way_target"), F.col("way_source")), 2).otherwise(1)
    ordered = full.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(relation, F.desc("score"), "atom")))
    grouped = search.payload_groups(ordered.withColumn("doc", F.col("atom")), ["kind", "state", "subject", "title", "query"])
    packets = packet.select(packet.formatted(grouped).select("request_id", "atom", "site", "record", "rank", "group_rank", "arms", "all_arms", "max_bytes"), d)
    each = asked.select("request_id", "same").distinct()
    return packets.withColumnRenamed("request_id", "same").join(each, "same").select("request_id", *packets.columns[1:])
