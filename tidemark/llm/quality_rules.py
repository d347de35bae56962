"""Quality rules with adaptive thresholds.

Every text gets features; the features of each (language, source) go into a mergeable quantile
sketch (logarithmic buckets with counts: relative error ``ACCURACY``, merged by adding counts); the
sketches give a fence for each feature, language and source, and documents are joined with the
fences of their group. A source with few documents uses its language's merged sketch, and a language
with few documents the merged sketch of all.

Defined results: a null or empty text has no words and fails the base rule; a null language or
source is a group of its own; repeated rows are scored one by one; a text that equals a fence is
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import Words, _table, keyed, runs, slices, sums
from .shared import stage

SYMBOLS = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
PUNCT = _table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
FEATURES = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_punct long"
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
#: A group with fewer documents takes the fences of the merged sketch above it.
LEAST_DOCS = 200
#: For each ratio: how far above (below) the median a document may be, in quartile distances, and the least distance.
#: A ratio under its floor never rejects.
FENCES = {"symbol_ratio": (6.0, 0.05), "dup_line_ratio": (6.0, 0.30), "repeat_ratio": (6.0, 0.30), "upper_ratio": (6.0, 0.05), "punct_ratio": (6.0, 0.05), "mean_word": (6.0, 1.5)}


def count_features(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of a batch of texts, all exact over the whole texts."""
    w = Words(texts)
    raw, off, n = w.raw, w.offsets, len(w.count)
    per = lambda flags: sums(flags, off)
    out = {"n_words": w.count.astype(np.int64), "word_chars": per(w.inside & ((raw & 0xC0) != 0x80)), "n_symbols": per(SYMBOLS[raw]), "n_upper": per(UPPER[raw]), "n_punct": per(PUNCT[raw])}
    # lines with a word: from a newline or a text's start to the next newline or the text's end
    newline = np.flatnonzero(raw == 10)
    begin = np.concatenate([off[:-1], newline + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(off, newline, "right") - 1])
    order = np.lexsort((begin, doc))
    begin, doc = begin[order], doc[order]
    end = np.append(begin[1:] - 1, len(raw))
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    end[last] = off[doc[last] + 1]
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(w.inside, out=filled[1:])
    has = filled[end] > filled[begin]
    begin, end, doc = begin[has], end[has], doc[has]
    lines = np.sort(keyed(w.hash_of(begin, end), doc))
    n_lines = np.bincount(doc, minlength=n)
    # distinct lines by row: the keys mix the row in, so look the rows up again
    order = np.argsort(keyed(w.hash_of(begin, end), doc), kind="stable")
    distinct = np.bincount(doc[order][runs(lines)], minlength=n)
    out |= {"n_lines": n_lines.astype(np.int64), "n_dup_lines": (n_lines - distinct).astype(np.int64)}
    # words inside three-word windows that the text has more than once
    at, h = w.windows(w.hashes(), 3)
    key = keyed(h, w.doc[at])
    order = np.argsort(key, kind="stable")
    begins = runs(key[order])
    often = np.diff(np.append(begins, len(key))) > 1
    repeated = np.zeros(len(key), bool)
    repeated[order] = np.repeat(often, np.diff(np.append(begins, len(key))))
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[at[repeated] + k] = True
    return out | {"n_repeat_words": w.per_doc(covered)}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts for each document, from one pass over the texts."""
    names = [x.split()[0] for x in FEATURES.split(", ")][3:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = count_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *[pa.array(got[k]) for k in names]], ["doc_id", "lang", "source", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")).where("doc_id is not null")
    return rows.mapInArrow(run, FEATURES)


def ratios() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)).cast("double"), F.greatest("word_chars", F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)).cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "punct_ratio": F.col("n_punct") / chars,
        "mean_word": F.col("word_chars") / words,
    }


def sketches(feats: DataFrame, accuracy: float = ACCURACY) -> DataFrame:
    """(lang, source, feature, bucket, n): the mergeable sketches of the documents that pass the base rule.
    Values in a bucket differ by less than twice the accuracy; zero has the bucket -2**31."""
    gamma = float(np.log((1 + accuracy) / (1 - accuracy)))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in ratios().items()])).alias("p")
    bucket = F.when(F.col("p.value") > 0, F.ceil(F.log(F.col("p.value")) / F.lit(gamma)).cast("int")).otherwise(F.lit(-(2**31)))
    rows = feats.where("not base_failed").select("lang", "source", pairs)
    return rows.select("lang", "source", "p.feature", bucket.alias("bucket")).groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], accuracy: float = ACCURACY) -> DataFrame:
    """Documents and quartiles of each (keys, feature), from sketches merged to those keys."""
    gamma = float((1 + accuracy) / (1 - accuracy))
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    each = Window.partitionBy(*keys, "feature")
    ranked = merged.select("*", F.sum("n").over(each.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(each).alias("docs"))
    value = F.when(F.col("bucket") == -(2**31), 0.0).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket").cast("double")) / (gamma + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.col("docs") * F.lit(q)), value))
    return ranked.groupBy(*keys, "feature").agg(F.max("docs").alias("docs"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def fences(sketch: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, lo_<f>, hi_<f>): the limits of each group that the sketches name."""
    own = quantiles(sketch, ["lang", "source"])
    by_lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("feature").alias("f"), *[F.col(c).alias(f"l_{c}") for c in ("docs", "q1", "q2", "q3")])
    of_all = quantiles(sketch, []).select(F.col("feature").alias("g"), *[F.col(c).alias(f"a_{c}") for c in ("q1", "q2", "q3")])
    rows = own.join(by_lang, own.lang.eqNullSafe(by_lang.l) & (own.feature == by_lang.f)).join(of_all, F.col("feature") == F.col("g"))
    pick = lambda c: F.when(F.col("docs") >= least_docs, F.col(c)).when(F.col("l_docs") >= least_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    out = rows.select("lang", "source", "feature", *[pick(c).alias(c) for c in ("q1", "q2", "q3")])
    limit = lambda name, up: F.max(F.when(F.col("feature") == name, F.col("q2") + (1 if up else -1) * F.greatest(FENCES[name][0] * ((F.col("q3") - F.col("q2")) if up else (F.col("q2") - F.col("q1"))), F.lit(FENCES[name][1]))))
    return out.groupBy("lang", "source").agg(*[limit(k, True).alias(f"hi_{k}") for k in FENCES], limit("mean_word", False).alias("lo_mean_word"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts, the fixed base rule and the adaptive verdict of every document.

    ``kept`` is false if the base rule fails, else whether every ratio lies within the fences of the document's
    language and source; ``failed_rules`` names the ratios outside.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    feats = stage(features(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed), "rules")
    limits = fences(sketches(feats), least_docs).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    joined = feats.join(limits, feats.lang.eqNullSafe(limits.g_lang) & feats.source.eqNullSafe(limits.g_source), "left")
    value = ratios()
    broken = [F.when(value[k] > F.col(f"hi_{k}"), F.lit(k)) for k in FENCES] + [F.when(value["mean_word"] < F.col("lo_mean_word"), F.lit("mean_word"))]
    joined = joined.withColumn("failed_rules", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.array_join(F.array(*broken), ",")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
