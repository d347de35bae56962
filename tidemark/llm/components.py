"""Connected components of edges too many for one machine, and exact links inside candidate clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, reclaim, stage

#: Edges (16 bytes each) that one task takes; more go the distributed way.
FEW = 1_000_000


def least_reachable(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the least node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(root, a, b)  # roots join smaller ones
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (src, dst).

    Up to ``few`` edges meet in one task, whose size so is bounded. Beyond, large-star and small-star steps in turn until nothing changes; a step takes the least neighbour of each node by a
    partial aggregate and joins it back, so a node with very many edges does not gather in one task."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    now = stage(now, "edges")
    if now.count() <= few:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
            for b in pa.table(dict(zip(("node", "component"), least_reachable(table["a"].to_numpy(), table["b"].to_numpy())))).to_batches(1 << 16):
                yield b

        return now.coalesce(1).mapInArrow(run, "node long, component long")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        reclaim(edges.sparkSession)  # shuffle files and tables of the steps before
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))


#: Links(members, x, rest): which of the members ``rest`` (indexes) are linked with member x.
Links = Callable[[object, int, np.ndarray], np.ndarray]


def spanning(count: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever all links connect. Members are visited breadth-first, each compared with those not
    yet reached; members all alike take one round."""
    out, left = [], np.arange(count)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = linked(x, left)
            out += [(x, int(y)) for y in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return out


def exact_links(members: DataFrame, prepare: Callable[[pa.Table], object], linked: Links, cap: int = 1000) -> DataFrame:
    """(src, dst): links that span the exact components inside each candidate cluster.

    members: (cluster, id, payload). ``prepare`` makes what ``linked`` compares from a table of members. A cluster of
    more than ``cap`` members is dealt into blocks. Blocks are linked inside first; then every member outside its
    cluster's largest component so far is compared with all blocks. Pairs inside that component are connected already,
    so no link is lost, and the work grows with the blocks times the members outside it."""
    members = stage(members, "cluster-members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("c") / cap)).cast("int")
    dealt = members.join(stage(sizes, "cluster-sizes"), "cluster").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    n = parts(members) * 2
    bucket = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).alias("bucket")

    def group_of(table: pa.Table, *names: str) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by([(c, "ascending") for c in (*names, "id")])
        keys = np.stack([table[c].to_numpy() for c in names], 1)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        return table, np.append(np.flatnonzero(new), len(keys))

    def inside(table: pa.Table) -> pa.Table:
        table, edges = group_of(table, "cluster", "block")
        src, dst = [], []
        for a, e in zip(edges[:-1], edges[1:]):
            if e - a > 1:
                own = table.slice(a, e - a)
                what, ids = prepare(own), own["id"].to_numpy()
                for x, y in spanning(e - a, lambda x, rest: linked(what, x, rest)):
                    src.append(ids[x])
                    dst.append(ids[y])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    kind = "src long, dst long"
    first = stage(dealt.select("cluster", "block", "id", "payload", bucket("cluster", "block")).groupBy("bucket").applyInArrow(inside, kind), "links")
    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return first
    comp = components(first).withColumnsRenamed({"node": "id", "component": "comp"})
    state = large.select("cluster", "id", "block", "blocks").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = state.groupBy("cluster", "comp").agg(F.countDistinct("id").alias("c")).groupBy("cluster").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("main"))
    state = stage(state.join(main, "cluster").distinct(), "blocks")
    outside = state.where("comp <> main")
    chunks = outside.groupBy("cluster").agg(F.ceil(F.count("*") / cap).cast("int").alias("chunks"))
    text = large.select("cluster", "id", "payload")
    one = state.join(chunks, "cluster").select("cluster", "id", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("probe"))
    two = outside.join(chunks, "cluster").select("cluster", "id", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("probe"))
    both = one.unionByName(two).join(text, ["cluster", "id"])

    def across(table: pa.Table) -> pa.Table:
        table, edges = group_of(table, "cluster", "block", "chunk")
        src, dst = [], []
        for a, e in zip(edges[:-1], edges[1:]):
            own = table.slice(a, e - a)
            what, ids, comps = prepare(own), own["id"].to_numpy(), own["comp"].to_numpy()
            probe = own["probe"].to_numpy(zero_copy_only=False)
            for x in np.flatnonzero(probe).tolist():
                rest = np.flatnonzero(~probe & (comps != comps[x]))
                hit = rest[linked(what, x, rest)] if len(rest) else rest
                for y in hit[np.unique(comps[hit], return_index=True)[1]].tolist():  # one link into each component
                    src.append(ids[x])
                    dst.append(ids[y])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    second = both.withColumn("bucket", bucket("cluster", "block", "chunk")).groupBy("bucket").applyInArrow(across, kind)
    return stage(first.unionByName(second), "links")


def candidate_edges(keyed: DataFrame, emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], alike: Callable[[np.ndarray, np.ndarray], np.ndarray], slicer: Callable) -> DataFrame:
    """(src, dst): edges that connect members that share a key and are ``alike`` by their sketches.

    emit(batch): (keys u64, ids i64, sketches u64[n, k]). Keys meet in packed buckets. A task passes on
    every member of a key, since any one may be the only one alike to a member that another task has; ``emit`` gives a
    member once a key and batch."""
    buckets = parts(keyed) * 2

    def link(key: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, key))
        key, ids, sketch = key[order], ids[order], sketch[order]
        new = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))[: len(key)]  # what several tasks have
        key, ids, sketch = key[new], ids[new], sketch[new]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        two = begin[size == 2]
        hit = two[alike(sketch[two], sketch[two + 1])]
        src, dst = [ids[hit]], [ids[hit + 1]]
        more = size > 2
        for a, n in zip(begin[more].tolist(), size[more].tolist()):
            found = spanning(n, lambda x, rest: alike(sketch[a + x][None, :], sketch[a + rest]))
            if found:
                pairs = np.array(found)
                src.append(ids[a + pairs[:, 0]])
                dst.append(ids[a + pairs[:, 1]])
        return np.concatenate(src), np.concatenate(dst)

    def send(batches):  # noqa: ANN001, ANN202
        for b in slicer(batches):
            key, ids, sketch = emit(b)
            if not len(key):
                continue
            bucket = (key >> np.uint64(40)).astype(np.int64) % buckets
            o = np.lexsort((ids, bucket))
            edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i = o[edges[k] : edges[k + 1]]
                out.append((k, key[i].tobytes(), np.diff(ids[i], prepend=0).tobytes(), sketch[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], ["bucket", "key", "ids", "sketch"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in table[c]]
        key, ids = np.concatenate(read("key", np.uint64)), np.concatenate([np.cumsum(x) for x in read("ids", np.int64)])
        src, dst = link(key, ids, np.concatenate(read("sketch", np.uint64)).reshape(len(key), -1))
        pairs = np.unique(np.stack([np.maximum(src, dst), np.minimum(src, dst)], 1), axis=0) if len(src) else np.zeros((0, 2), np.int64)
        return pa.table({"src": pairs[:, 0], "dst": pairs[:, 1]})

    packed = keyed.mapInArrow(send, "bucket int, key binary, ids binary, sketch binary")
    return packed.groupBy("bucket").applyInArrow(meet, "src long, dst long").distinct()
