"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(w0 + sum of w[i] + sum over pairs of <v[i], v[j]>) over a text's distinct hashed terms, so that
pairs, such as an insult with a mention of a group, count beyond their parts, also where neither part tells anything
alone. Every term that ``LEAST_DF`` of the texts learnt from have takes part, and shrinkage decides its weight.

The model is fitted on a bounded sample of the labelled rows (``SAMPLE`` rows and ``SAMPLE_TERMS`` terms), chosen by hash
of the id, in one task: first single weights under an absolute-value penalty, which tells terms that matter alone from the
others; then those weights without it; then the factors of all terms beside them. The model's size is fixed by ``BITS``
and ``FACTORS``, so it can be broadcast; every text is scored whole.

Defined results: null and empty texts have the score of the intercept; a label that is null counts for nothing;
several labels of one id count as toxic if any does; rows with an id in the held-out fold are never learnt from;
repeated rows are scored one by one; without any labelled row every score is that of the intercept -30, under 1e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import NOT_ALNUM, U, Words, keyed, mix, runs, slices
from .shared import stage

#: Bits of a hashed term, factors, and bytes of word beginnings.
BITS, FACTORS, STEMS = 19, 8, (4, 6)
#: At most so many labelled rows are learnt from (of each class: half of it), with so many distinct terms in all.
SAMPLE, SAMPLE_TERMS = 16_000, 16_000_000
#: Fitting: rows in a batch; batches for the choice of single weights, for their refit, and with factors; steps of weights
#: and factors; penalty of the choice, shrinkage of weights and factors; sample texts that a term needs.
BATCH, CHOICE, REFIT, PAIRS, RATE, RATE_V, L1_W, L2_W, L2_V, LEAST_DF = 256, 500, 250, 250, 0.3, 0.05, 3e-3, 1e-5, 2e-3, 8


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct terms of each text, and where each text's begin.

    Terms are lower-cased words, word beginnings of ``STEMS`` bytes (for inflected and compound words), and each
    beginning again with "at least 2" and "at least 4 times"."""
    w = Words(texts, NOT_ALNUM, lower=True)
    h, doc = [w.hashes()], [w.doc]
    for n in STEMS:
        long = w.end - w.start > n
        stems = w.hash_of(w.start[long], w.start[long] + n)
        rows = w.doc[long]
        key = keyed(stems, rows)
        order = np.argsort(key, kind="stable")
        begin = runs(key[order])
        count, one = np.diff(np.append(begin, len(key))), order[begin]
        for k, least in enumerate((1, 2, 4)):
            h.append(mix(stems[one[count >= least]] + U(n * 8 + k)))
            doc.append(rows[one[count >= least]])
    slot = (np.concatenate(h) >> U(64 - BITS)).astype(np.int64)
    key = np.unique((np.concatenate(doc).astype(np.int64) << BITS) | slot)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(texts) + 1))


def _segments(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return np.diff(total[first], axis=0)


def logits(slots: np.ndarray, first: np.ndarray, model: dict) -> np.ndarray:
    v = model["v"][slots]
    s = _segments(v, first)
    return model["w0"] + _segments(model["w"][slots], first) + 0.5 * (s * s - _segments(v * v, first)).sum(1)


def fit(slots: list[np.ndarray], y: np.ndarray, n: int, factors: int = FACTORS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """(w0, w, v): Adagrad on the logistic loss over texts (the numbers, under n, of their terms) and their labels."""
    rng, base = np.random.default_rng(seed), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    every, edge = np.concatenate(slots), np.concatenate([[0], np.cumsum([len(x) for x in slots])])
    w0, w, v = np.log(base / (1 - base)), np.zeros(n), rng.normal(0, 0.01, (n, factors))
    g0, gw, gv = 1e-2, np.full(n, 1e-2), np.full((n, factors), 1e-2)
    order, active = np.zeros(0, np.int64), np.ones(n, bool)
    for turn in range(CHOICE + REFIT + (PAIRS if factors else 0)):
        if turn == CHOICE:
            active, gw = w != 0, np.full(n, 1e-2)
        choice, pairs = turn < CHOICE, turn >= CHOICE + REFIT
        if not len(order):
            order = rng.permutation(len(slots))
        rows, order = order[:BATCH], order[BATCH:]
        size = edge[rows + 1] - edge[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        flat = every[np.repeat(edge[rows] - first[:-1], size) + np.arange(first[-1])]
        z = w0 + _segments(w[flat], first)
        if pairs:
            vf = v[flat]
            s = _segments(vf, first)
            z += 0.5 * ((s * s).sum(1) - _segments((vf * vf).sum(1), first))
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]
        e = np.repeat(err, size)
        g0 += err.mean() ** 2
        w0 -= RATE * err.mean() / np.sqrt(g0)
        dw = np.bincount(flat, e, n) / len(rows)
        dw = dw if choice else np.where(active, dw + L2_W * w, 0)
        gw += dw**2
        step = RATE / np.sqrt(gw)
        w = w - step * dw
        if choice:
            w = np.sign(w) * np.maximum(np.abs(w) - step * L1_W, 0)
        if pairs:
            each = e[:, None] * (np.repeat(s, size, axis=0) - vf)
            dv = np.stack([np.bincount(flat, each[:, f], n) for f in range(factors)], 1) / len(rows) + L2_V * v
            gv += dv**2
            v -= RATE_V * dv / np.sqrt(gv)
    return float(w0), w, v


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, factors: int = FACTORS, most: int = SAMPLE_TERMS) -> dict:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, half of them toxic where there are as many, and
    on no more of them, in the order of their ids' hashes, than have ``most`` frequent terms together."""
    spark = docs.sparkSession
    out = {"w0": -30.0, "w": np.zeros(1 << BITS, np.float32), "v": np.zeros((1 << BITS, factors), np.float32)}
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out())
    chosen = marks.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2).unionByName(marks.where("y <> 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            slots, first = terms(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([slots[a:e].tobytes() for a, e in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "y", "slots"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for x in b.column("slots"):
                df[np.frombuffer(x.as_buffer(), np.int32)] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["slot", "n"])

    kind = "doc_id long, y int, slots binary"
    texts = stage(rows.mapInArrow(cut, kind), "learnt")
    used = texts.select("slots").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_DF)
    used = np.sort(used.select("slot").toArrow()["slot"].to_numpy())  # at most 2**BITS
    names = spark.sparkContext.broadcast(used)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[names.value] = np.arange(len(names.value))
        for b in batches:
            own = [number[np.frombuffer(x.as_buffer(), np.int32)] for x in b.column("slots")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([x[x >= 0].tobytes() for x in own], pa.binary())], ["doc_id", "y", "slots"])

    texts = stage(texts.mapInArrow(frequent, kind), "frequent")
    texts = texts.withColumn("h", F.xxhash64("slots"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    within = texts.select("doc_id", "h", F.octet_length("slots").alias("n")).withColumn("sum", F.sum("n").over(upto)).where(F.col("sum") <= 4 * most).select("doc_id", "h").distinct()  # of at most ``sample`` ids
    learnt = texts.join(F.broadcast(within), ["doc_id", "h"], "left_semi").select("doc_id", "y", "slots")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("slots", pa.binary())])).sort_by([("doc_id", "ascending"), ("slots", "ascending")])
        if table.num_rows:
            y = table["y"].to_numpy().astype(np.float64)
            w0, w, v = fit([np.frombuffer(x.as_buffer(), np.int32) for x in table["slots"]], y, len(names.value), factors)
            yield pa.RecordBatch.from_arrays([pa.array([w0]), pa.array([float(y.mean())]), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["w0", "p", "w", "v"])

    got = learnt.repartition(1).mapInArrow(learn, "w0 double, p double, w binary, v binary").toArrow()  # the model: its size is fixed
    names.destroy()
    if got.num_rows:
        mean, total = got["p"][0].as_py(), marks.agg(F.avg("y").alias("p")).first()["p"]
        out["w0"] = got["w0"][0].as_py()
        out["w"][used] = np.frombuffer(got["w"][0].as_buffer(), np.float32)
        out["v"][used] = np.frombuffer(got["v"][0].as_buffer(), np.float32).reshape(len(used), factors)
        if 0 < mean < 1 and 0 < total < 1:  # the sample holds more toxic rows than the labels do
            out["w0"] += float(np.log(total / (1 - total)) - np.log(mean / (1 - mean)))
    return out


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; the model's size is fixed, so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            slots, first = terms(b.column("text"))
            z = logits(slots, first, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """Score of every document; ``predicted`` is 1 from 0.5 on."""
    columns = {k: x for k, x in options.items() if k in ("id_col", "text_col")}
    scored = score(docs, train(docs, labels, **options), **columns)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
