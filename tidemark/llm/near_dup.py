"""Near-duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles. Equal sets form classes; a class has a minwise signature. A tree branches
a class's path by minwise tokens: at each level a hash of the path so far chooses one coordinate of the signature, or
two, so that there are 1 / threshold of them on average, and the token there continues the path. A pair at the
threshold keeps a common path with the same expected number at every level, a dissimilar one loses it quickly.
``TREES`` independent trees reach the target recall: a pair of similarity 0.8 is missed by a tree with probability
0.52 at depth 6, by 12 trees with 0.0004; more similar pairs by far less. The members of a node are compared with each
other by sketches of 128 bits, which connect them into candidate clusters; clusters are compared exhaustively on
the full sets, up to what is connected already.

Defined results: null, empty and wordless texts have no shingles and are linked with nothing; a text with fewer words
than a shingle is one shingle; a similarity equal to the threshold links; rows with the same id are one document as
to reachability; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import candidate_edges, components, exact_links
from .hashing import U, Words, mix, slices
from .shared import maybe_in, reclaim, stage

COORDINATES, TREES, DEPTH = 128, 12, 6
#: Standard deviations below the expected agreement of 128-bit sketches at the threshold.
SLACK = 4.5
SHINGLE, PERCENT = 5, 80
_A = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_B = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0xD1B54A32D192ED03))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and where each text's begin."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at, window = w.windows(h, n)
    row = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    extra = np.zeros(len(short), U)
    for i, r in enumerate(short.tolist()):
        acc = np.array([w.count[r]], U)
        for x in h[w.first[r] : w.first[r + 1]]:
            acc = mix(acc * U(31) + x)
        extra[i] = acc[0]
    value, row = np.concatenate([window, extra]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, set1, set2, sig): size, two hashes and the minwise signature of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            value, first = shingles(b.column("text"), n)
            size = np.diff(first)
            some = np.flatnonzero(size)
            sig = np.zeros((len(size), COORDINATES), np.uint32)
            sums = [np.zeros(len(size), U), np.zeros(len(size), U)]
            if len(some):
                start = first[:-1][some]
                for k in range(2):
                    sums[k][some] = np.add.reduceat(mix(value ^ U(0xA5A5 + k)), start)
                for k in range(COORDINATES):
                    sig[some, k] = np.minimum.reduceat(((value * _A[k] + _B[k]) >> U(32)).astype(np.uint32), start)
            sigs = [sig[i].tobytes() if size[i] else None for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set1", "set2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, sig binary")


def paths(sig: np.ndarray, percent: int, trees: int = TREES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of every path's end. sig: u32[rows, COORDINATES]."""
    rows, nodes, per = [], [], COORDINATES // depth
    twice = int((100 / percent - 1) * 1024)
    for t in range(trees):
        row = np.arange(len(sig))
        node = np.full(len(sig), mix(np.array([t + 1], U))[0], U)
        for level in range(depth):
            r = mix(node + U(level + 1))
            one = (r % U(per)).astype(np.int64)
            more = np.flatnonzero(((r >> U(20)) % U(1024)).astype(np.int64) < twice)
            two = (one[more] + 1 + ((r[more] >> U(40)) % U(per - 1)).astype(np.int64)) % per
            row, node = np.concatenate([row, row[more]]), np.concatenate([node, node[more]])
            at = level * per + np.concatenate([one, two])
            node = mix(node ^ mix((at.astype(U) << U(32)) + sig[row, at].astype(U) + U(1)))
        rows.append(row)
        nodes.append(node)
    return np.concatenate(rows), np.concatenate(nodes)


def _sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value, first = shingles(table["payload"], n)
    return value, first, np.diff(first)


def _linked(sets: tuple[np.ndarray, np.ndarray, np.ndarray], x: int, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which of the members ``rest`` have 100 * intersection >= percent * union with member x."""
    value, first, size = sets
    own = value[first[x] : first[x + 1]]
    out = np.zeros(len(rest), bool)
    near = np.flatnonzero((100 * np.minimum(size[rest], len(own)) >= percent * np.maximum(size[rest], len(own))) & (size[rest] > 0))
    if not len(near) or not len(own):
        return out
    length = size[rest[near]]
    at = np.repeat(first[:-1][rest[near]], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    other = value[at]
    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
    both = np.add.reduceat((own[place] == other).astype(np.int64), np.cumsum(length) - length)
    out[near] = 100 * both >= percent * (length + len(own) - both)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, trees: int = TREES, cap: int = 1000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept is the least id of each component."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sets = stage(signatures(rows, shingle), "sets")
    key = ["set1", "set2", "n_shingles"]
    classes = stage(sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")), "classes")
    expected = 128 * (1 + percent / 100) / 2
    least = int(expected - SLACK * (expected * (1 - expected / 128)) ** 0.5)

    def emit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, COORDINATES)
        bits = np.packbits((sig & 1).astype(np.uint8), axis=1).view(U).reshape(b.num_rows, -1)
        row, node = paths(sig, percent, trees)
        return node, np.asarray(b.column("rep"))[row], bits[row]

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 128 - np.bitwise_count(a ^ b).sum(-1).astype(np.int64) >= least

    edges = stage(candidate_edges(classes.select("rep", "sig"), emit, alike, lambda batches: slices(batches, "sig", 16 << 20)), "candidates")
    reclaim(spark)
    clusters = components(edges)
    near = maybe_in(clusters, "node")  # most documents are in no cluster, and their texts need not travel
    members = near(rows, "doc_id", "_near").where("_near").join(clusters, F.col("doc_id") == F.col("node")).select(F.col("component").alias("cluster"), F.col("doc_id").alias("id"), F.col("text").alias("payload"))
    links = exact_links(members, lambda table: _sets(table, shingle), lambda what, x, rest: _linked(what, x, rest, percent), cap)
    reclaim(spark)
    member = classes.select(*key, "rep")
    of = sets.where("n_shingles > 0").select("doc_id", *key).join(member, key).select("doc_id", "n_shingles", "rep")
    # rows with one id but several sets join those sets' classes
    several = of.where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all")).where("a < b").select(F.explode("all").alias("src"), F.col("a").alias("dst"))
    own = of.groupBy("doc_id").agg(F.min("rep").alias("dst"), F.max("rep").alias("src")).where("src > dst").select("src", "dst")
    comp = stage(components(links.unionByName(several).unionByName(own)), "components")
    found = of.join(comp, of.rep == comp.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    none = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(none).withColumn("kept", F.col("doc_id") == F.col("component_id"))
