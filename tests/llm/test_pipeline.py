"""The pipeline's stages on the smallest tables, and each against brute force on its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, components_of, prose

from tidemark.llm import decontaminate, line_dedup, quality_lm

DATA = "/root/testdata/sf0.001"
#: Columns of documents, and some that the operators use names of.
KIND = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, cluster string, node long, tag long, _some string"


def test_stages_keep_columns_and_pack_what_is_left(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == before


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.n_chars) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Copies, near copies, repeated lines, leaks, junk, nulls in every column, empty and long texts, repeated rows."""
    rng, path = random.Random(31), str(tmp_path_factory.mktemp("tables"))
    items = {i: prose(rng, 25, 3000) for i in range(4)}
    header = "this header line stands in many of the documents of the source"
    text = {i: "\n".join(prose(rng, rng.randrange(12, 40)) for _ in range(4)) for i in range(90)}
    for i in range(60, 66):
        text[i] = text[i - 60] + "\nand one line more of " + prose(rng, 3)
    for i in range(66, 72):
        text[i] = f"{header}{'!' * (i % 3)}\n{text[i]}\nMenu\nMenu"
    for i in range(72, 76):
        text[i] = f"{text[i]}\n{prose(rng, 6)} {items[i - 72]} {prose(rng, 6)}"
    text |= {90: None, 91: "", 92: " \n\t", 93: "### $$$ %%% ### 0x0x0x " * 30, 94: prose(rng, 15_000), 95: text[5]}
    rows = [(i, t, [None, "en"][i % 20 > 0], None if i % 7 == 0 else "s", None if t is None else len(t), None, "c", i, 1, None) for i, t in text.items()]
    rows += [rows[8], rows[8], rows[90], (None, "a row without an id", "en", "s", 19, True, None, None, None, "x")]
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, 0) for i in range(60)] + [(93, 0, 0), (None, 1, 1), (12, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items.items(), (9, None), (None, "no id")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_against_brute_force(spark, tables):
    path, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {"": rows_of(docs)}
    for name in list(stages)[:-1]:
        if name == "quality_classifier":
            verdict = {r.doc_id: r.kept for r in quality_lm.classify(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()}
        before = docs
        docs = corpus_pipeline.stage(stages[name](spark, docs, path), name)
        assert docs.columns == before.columns
        kept[name] = rows_of(docs)
    # rejected go, all else stays as it is
    assert kept["quality_classifier"] == [r for r in kept[""] if r[0] is None or verdict[r[0]]]
    assert {90, 91, 93} <= {i for i, k in verdict.items() if not k} and all(verdict[i] for i in range(60))
    # lines: a later one within two edits of an earlier one, or a short one that equals it, goes
    source = kept["quality_classifier"]
    lines = sorted({(i, k, x) for i, t, _, _ in source if i is not None and t is not None for k, x in enumerate(t.split("\n"))})
    distinct = sorted({x for _, _, x in lines if re.search(r"[^\x20\x09-\x0D]", x)})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if min(len(a), len(b)) >= line_dedup.LEAST and abs(len(a) - len(b)) <= 2 and line_dedup.within(a, b, 2):
                root[find(a)] = find(b)
    first = {}
    for i, k, x in lines:
        if x in root:
            first.setdefault(find(x), (i, k))
    want = []
    for i, t, lang, n in source:
        if i is not None and t is not None:
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if x not in root or first[find(x)] == (i, k))
        want.append((i, t, lang, None if t is None else len(t)))
    assert kept["line_dedup"] == sorted(want, key=repr)
    # near-duplicates: the least id of each component of five-word sets
    source = [r for r in kept["line_dedup"] if r[0] is not None]
    sets = {}
    for i, t, _, _ in source:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    least = components_of(sets, 80)
    assert kept["near_dedup"] == [r for r in kept["line_dedup"] if r[0] is None or least[r[0]] == r[0]]
    # leaks: whole items go; what has less than half of any item in order stays
    left = {r[0] for r in kept["benchmark_decontamination"]}
    for i, t, _, _ in kept["near_dedup"]:
        w = WORD.findall((t or "").lower())
        for item in items.values():
            x, bits = item.lower().split(), {}
            for k, word in enumerate(x):
                bits[word] = bits.get(word, 0) | 1 << k
            if item.lower() in (t or "").lower():
                assert i not in left
        if all(decontaminate.lcs({v: sum(1 << k for k, y in enumerate(x.lower().split()) if y == v) for v in set(x.lower().split())}, len(x.split()), w) < 0.5 * len(x.split()) for x in items.values()):
            assert i in left
    assert {72, 73, 74, 75}.isdisjoint(left)
    packed = stages["best_fit_packing"](spark, docs, path).collect()
    assert {r.doc_id for r in packed} == {i for i in left if i is not None}
    fill = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024


def test_empty_tables(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(stage(spark, docs, path), name)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)
