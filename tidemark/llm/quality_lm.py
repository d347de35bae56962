"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

N-grams of all trusted texts are counted by language, exactly and without a sample; lower orders count continuations.
From the counts come, natively, a discounted probability for each n-gram and a back-off weight for each context. These
tables are exact and grow with the distinct n-grams. What a byte looks up is settled by the two bytes before it, but for
n-grams of at most two bytes; so a language's tables are cut by these two bytes into parts of about ``TABLE`` entries, each
with all the short n-grams. Documents meet the parts by broadcast, as many at once as ``TABLE`` entries allow, and a
document's negative log-probability is the sum of what its bytes have in each part of its language. Every language with
enough trusted texts has tables of its own; small ones are broadcast together.

The mean negative log-probability a byte (the log of the perplexity) is held against a quantile of trusted texts' values
in the same language. These are out of sample: trusted texts are dealt into ``FOLDS`` folds by hash, and each is scored
by a model of the other folds' texts. Short texts vary more, so the quantile is taken of the value less ``SHORT`` over
the square root of a text's bytes, which the text's own threshold gets back. Documents above it are rejected.

Defined results: a null or empty text has log_perplexity null and is rejected; a null language is the empty
one; a language with fewer than ``LEAST_TRUSTED`` trusted texts uses the model and threshold of all languages together;
a text at the threshold is kept; several labels of one id count as trusted if any does; repeated rows are scored one by
one; without any trusted text only empty texts are rejected; a document of no language with a model is held against the pooled
texts' quantile; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U, buffer_of, slices
from .shared import maybe_in, stage

ORDER = 5
#: Entries of the tables that are broadcast at once, of 12 bytes each.
TABLE = 3 << 20
#: Quantile of trusted texts that the threshold is, a margin above it, and what is added over the square root of a text's bytes.
QUANTILE, MARGIN, SHORT = 0.99, 0.05, 2.5
FOLDS = 2
LEAST_TRUSTED = 50
#: The model of all languages together; and what stands between a language and the fold that its model leaves out.
POOLED, LEFT_OUT = "\x1e", "\x1f"
#: Distinct n-grams that a task sums before it passes them on.
HELD = 1 << 20


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the n-gram of ORDER bytes that ends there, its own byte lowest; zeros before a text's begin. Rows, offsets."""
    raw, offsets = buffer_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    since = np.arange(len(raw)) - offsets[doc]
    code = np.zeros(len(raw), U)
    for k in range(ORDER):
        byte = np.zeros(len(raw), U)
        byte[k:] = raw[: len(raw) - k]
        code |= np.where(since >= k, byte, U(0)) << U(8 * k)
    return code, doc, offsets


def part_of(code: np.ndarray, pieces: int) -> np.ndarray:
    """The part of its language's tables in which each n-gram's byte finds all it looks up: by the two bytes before it."""
    pair = (code >> U(8)) & U(0xFFFF)
    return ((((pair * U(40503)) & U(0xFFFF)) * U(pieces)) >> U(16)).astype(np.int64)


def part_column(pair: Column) -> Column:
    """As ``part_of``, of the two bytes, among ``pieces``."""
    return F.shiftright((pair * 40503).bitwiseAND(F.lit(0xFFFF)) * F.col("pieces"), 16).cast("int")


def counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over all texts; sums inside tasks go before the shuffle."""

    def batch(name: str, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n)], ["lang", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, most=1 << 18):
            lang = np.array(b.column("lang").to_pylist(), object)
            code, doc, _ = codes(b.column("text"))
            for name in set(lang.tolist()):
                new, n = np.unique(code[(lang == name)[doc]], return_counts=True)
                if name in total:
                    new, at = np.unique(np.concatenate([total[name][0], new]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([total[name][1], n]), len(new)).astype(np.int64)
                total[name] = (new, n.astype(np.int64))
                if len(new) > HELD:
                    yield batch(name, *total.pop(name))
        for name, (code, n) in total.items():
            yield batch(name, code, n)

    return docs.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def shards(exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, part, ord, kind, codes, data): codes in order and their float32 values: ``p`` discounted probabilities of
    n-grams, ``b`` weights of contexts. And (lang, entries, pieces): how many parts each language has."""
    level = exact.select("lang", "code", "n")
    every = level.withColumn("ord", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):  # n-grams without their earliest byte: how many distinct bytes stand before them
        level = level.groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("code")).agg(F.count("*").alias("n"))
        every = every.unionByName(level.withColumn("ord", F.lit(k)))
    every = stage(every, "ngrams")
    kinds = every.groupBy("lang", "ord").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    discount = lambda i: F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))))
    kinds = kinds.select("lang", "ord", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
    context = F.shiftrightunsigned("code", 8)
    sums = every.groupBy("lang", "ord", context.alias("ctx")).agg(F.sum("n").cast("double").alias("total"), *[F.count_if(c).cast("double").alias(f"c{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") >= 3))]).join(F.broadcast(kinds), ["lang", "ord"])  # a row for each language and order
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    p = every.withColumn("ctx", context).join(sums, ["lang", "ord", "ctx"]).select("lang", "ord", F.lit("p").alias("kind"), "code", ((F.col("n") - d) / F.col("total")).alias("v"))
    b = sums.select("lang", "ord", F.lit("b").alias("kind"), F.col("ctx").alias("code"), ((F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")) / F.col("total")).alias("v"))

    entries = stage(p.unionByName(b), "entries")
    sizes = entries.groupBy("lang").agg(F.count("*").alias("entries")).select("lang", "entries", F.ceil(F.col("entries") / TABLE).cast("long").alias("pieces"))
    sizes = stage(sizes, "sizes")
    long = F.col("ord") >= 3  # n-grams of three bytes, contexts of two
    pair = F.when(F.col("kind") == "p", F.shiftrightunsigned("code", 8)).otherwise(F.col("code")).bitwiseAND(F.lit(0xFFFF))
    part = F.explode(F.when(long, F.array(part_column(pair))).otherwise(F.sequence(F.lit(0), (F.col("pieces") - 1).cast("int")))).alias("part")
    placed = entries.join(F.broadcast(sizes), "lang").select("lang", part, "ord", "kind", "code", "v")  # a row for each language

    def table(rows: pa.Table) -> pa.Table:
        code, v = rows["code"].to_numpy().view(U), rows["v"].to_numpy().astype(np.float32)
        order = np.argsort(code)
        one = [rows[c].slice(0, 1).combine_chunks() for c in ("lang", "part", "ord", "kind")]
        return pa.table([*one, pa.array([code[order].tobytes()], pa.binary()), pa.array([v[order].tobytes()], pa.binary())], ["lang", "part", "ord", "kind", "codes", "data"])

    return placed.groupBy("lang", "part", "ord", "kind").applyInArrow(table, "lang string, part int, ord int, kind string, codes binary, data binary"), sizes


def passes(sizes: DataFrame) -> tuple[dict[str, int], list[list[tuple[str, int]]]]:
    """Parts of each language, and the (language, part) that are broadcast together: of about TABLE entries."""
    pieces, out, room = {}, [], 0
    for r in sizes.orderBy("lang").toLocalIterator():  # a row for each language
        pieces[r["lang"]] = r["pieces"]
        for k in range(r["pieces"]):
            need = r["entries"] // r["pieces"]
            if need > room:
                out.append([])
                room = TABLE
            out[-1].append((r["lang"], k))
            room -= need
    return pieces, out


def found(table: tuple[np.ndarray, np.ndarray] | None, code: np.ndarray, other: float) -> np.ndarray:
    """Values of the codes, and ``other`` for those that the table lacks."""
    if table is None or not len(table[0]):
        return np.full(len(code), other)
    at = np.minimum(np.searchsorted(table[0], code), len(table[0]) - 1)
    return np.where(table[0][at] == code, table[1][at], other).astype(np.float64)


def surprise(tables: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], code: np.ndarray) -> np.ndarray:
    """Negative log-probability of the last byte of each n-gram."""
    distinct, back = np.unique(code, return_inverse=True)
    prob = np.full(len(distinct), 1 / 256)
    for k in range(1, ORDER + 1):
        own = found(tables.get((k, "p")), distinct & U((1 << (8 * k)) - 1), 0.0)
        prob = own + found(tables.get((k, "b")), (distinct >> U(8)) & U((1 << (8 * (k - 1))) - 1), 1.0) * prob
    return -np.log(np.clip(prob, 1e-12, 1.0))[back]


def perplexities(docs: DataFrame, model: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, lang, model, n_bytes, log_perplexity) of every whole text by the tables of its ``model``, or without any,
    where every byte is as likely. A text whose model's tables have several parts is read for each of them."""
    pieces, rounds = passes(sizes)
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text", "model")
    kind = "doc_id long, lang string, model string, tag long, n_bytes long, total double"

    def tables(chosen: list[tuple[str, int]]) -> object:
        """Those parts, broadcast: about TABLE entries of 12 bytes, which the driver holds only until they are sent."""
        got: dict[tuple[str, int], dict] = {pair: {} for pair in chosen}
        wanted = F.concat_ws(":", F.col("part").cast("string"), "lang").isin([f"{k}:{lang}" for lang, k in chosen])
        for r in model.where(wanted).toLocalIterator():
            got[r["lang"], r["part"]][r["ord"], r["kind"]] = (bytes(r["codes"]), bytes(r["data"]))
        return spark.sparkContext.broadcast(got)

    def scored(some: DataFrame, chosen: list[tuple[str, int]]) -> DataFrame:
        shared = tables(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = {pair: {k: (np.frombuffer(c, U), np.frombuffer(d, np.float32)) for k, (c, d) in t.items()} for pair, t in shared.value.items()}
            held: dict[str, list[int]] = {}
            for name, k in here:
                held.setdefault(name, []).append(k)
            for x in slices(batches, most=1 << 18):
                own = x.column("model").to_pylist()
                code, doc, offsets = codes(x.column("text"))
                value = np.zeros(len(code))
                for name in set(own):
                    mine = np.array([o == name for o in own])[doc]
                    for k in held.get(name, []):
                        rows = np.flatnonzero(mine)
                        if pieces.get(name, 1) > 1:
                            rows = rows[part_of(code[rows], pieces[name]) == k]
                        value[rows] = surprise(here[name, k], code[rows])
                total = np.concatenate([np.zeros(1), np.cumsum(value)])
                yield pa.RecordBatch.from_arrays([*[x.column(c) for c in ("doc_id", "lang", "model", "tag")], pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets]))], ["doc_id", "lang", "model", "tag", "n_bytes", "total"])

        out = stage(some.mapInArrow(run, kind), "perplexity")
        shared.destroy()
        return out

    several = [lang for lang, n in pieces.items() if n > 1]
    whole, cut = [], []
    if not pieces:  # no trusted text
        whole.append(scored(rows.withColumn("tag", F.lit(0).cast("long")), [(POOLED, 0)]))
    for chosen in rounds:
        single = [(n, k) for n, k in chosen if n not in several]
        for some, out, tag in ((single, whole, F.lit(0).cast("long")), ([c for c in chosen if c not in single], cut, F.xxhash64("text"))):
            if some:
                out.append(scored(rows.where(F.col("model").isin(sorted({n for n, _ in some}))).withColumn("tag", tag), some))
    result = reduce(DataFrame.unionByName, whole).select(*[c.split()[0] for c in kind.split(", ") if not c.startswith("tag")]) if whole else None
    if cut:
        # equal rows of a document have equal sums: they are told from parts by their number in each pass
        each = reduce(DataFrame.unionByName, [df.withColumn("_pass", F.lit(i)) for i, df in enumerate(cut)])
        one = each.groupBy("doc_id", "lang", "model", "tag", "n_bytes", "_pass").agg(F.max("total").alias("total"), F.count("*").alias("_same"))
        all_ = one.groupBy("doc_id", "lang", "model", "tag", "n_bytes").agg(F.sum("total").alias("total"), F.max("_same").cast("int").alias("_same"))
        again = all_.select("doc_id", "lang", "model", "n_bytes", "total", F.explode(F.sequence(F.lit(1), F.col("_same")))).drop("col")
        result = again if result is None else result.unionByName(again)
    return result.select("doc_id", "lang", "model", "n_bytes", F.when(F.col("n_bytes") > 0, F.col("total") / F.col("n_bytes")).alias("log_perplexity"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Log-perplexity, threshold and verdict (``kept``) of every document. Trusted are the texts with label 1."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.translate(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), POOLED + LEFT_OUT, "").alias("lang")).where("doc_id is not null")
    ids = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = stage(ids, "trusted")
    trusted = maybe_in(ids, "doc_id")(rows, "doc_id", "_near").where("_near").drop("_near").join(ids, "doc_id", "left_semi")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    trusted = stage(trusted.withColumn("fold", fold), "texts")
    sizes = trusted.groupBy("lang").agg(F.count("*").alias("texts")).where(F.col("texts") >= LEAST_TRUSTED).select(F.col("lang").alias("own"))
    sizes = stage(sizes, "languages")  # a row for each language
    exact = stage(counts(trusted.withColumn("lang", F.concat("lang", F.lit(LEFT_OUT), F.col("fold").cast("string")))), "counts")
    exact = exact.select(F.regexp_extract("lang", f"(?s)^(.*){LEFT_OUT}", 1).alias("lang"), F.regexp_extract("lang", f"{LEFT_OUT}([0-9]+)$", 1).cast("int").alias("fold"), "code", "n")
    # each count goes to the model of its language and the pooled one, whole and without each other fold
    others = F.filter(F.sequence(F.lit(0), F.lit(FOLDS - 1)), lambda k: k != F.col("fold"))
    models = lambda name: F.concat(F.array(name), F.transform(others, lambda k: F.concat(name, F.lit(LEFT_OUT), k.cast("string"))))
    known = exact.join(F.broadcast(sizes), F.col("lang") == F.col("own"), "left")
    names = F.concat(F.when(F.col("own").isNotNull(), models(F.col("lang"))).otherwise(F.array().cast("array<string>")), models(F.lit(POOLED)))
    summed = known.select(F.explode(names).alias("lang"), "code", "n").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    model, parts_of = shards(summed)
    model = stage(model, "shards")
    own = F.coalesce("own", F.lit(POOLED))
    judged = perplexities(rows.join(F.broadcast(sizes), F.col("lang") == F.col("own"), "left").select("doc_id", "lang", "text", own.alias("model")), model, parts_of)
    out_of_sample = trusted.join(F.broadcast(sizes), F.col("lang") == F.col("own"), "left")
    pooled = F.lit(POOLED)
    if rows.select("lang").distinct().join(F.broadcast(sizes), F.col("lang") == F.col("own"), "left_anti").isEmpty():
        marked = out_of_sample.withColumn("base", own)  # no document needs the pooled threshold
    else:
        marked = out_of_sample.withColumn("base", F.explode(F.array_distinct(F.array(own, pooled))))
    marked = marked.withColumn("model", F.concat("base", F.lit(LEFT_OUT), F.col("fold").cast("string")))
    marks = perplexities(marked, model, parts_of).where("log_perplexity is not null")
    free = F.col("log_perplexity") - F.lit(SHORT) / F.sqrt("n_bytes")
    limits = marks.groupBy(F.regexp_extract("model", f"(?s)^(.*){LEFT_OUT}", 1).alias("model")).agg((F.percentile_approx(free, F.lit(quantile), F.lit(10000)) + margin).alias("limit"))
    judged = judged.join(F.broadcast(limits), "model", "left")  # a row for each model
    threshold = F.coalesce("limit", F.lit(math.inf)) + F.lit(SHORT) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    return judged.select("doc_id", "n_bytes", "log_perplexity", threshold.alias("threshold"), (F.col("log_perplexity").isNotNull() & (F.coalesce("log_perplexity", F.lit(0.0)) <= threshold)).alias("kept"))
