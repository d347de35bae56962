"""Packing of documents into sequences of a fixed length by a grouping genetic algorithm.

A text longer than a sequence is cut into full pieces (the first may be shorter); only those. Pieces are dealt into
blocks by hash. For each block several islands evolve groupings, each a row of a table and so a task's work: a round of
generations on all islands, then the best grouping of each island goes to the next one through an exchange, and so on.
Groupings begin as best-fit of the pieces in random order. Crossover injects well-filled bins of one parent whole into
the other; bins that then hold a piece twice are dissolved, as are some of the emptiest (mutation), and the displaced
pieces are put back best-fit. An island rests once a grouping has as few bins as the sum of lengths allows. Of a block's
islands the best grouping counts. Its bins that are nearly full are final; the pieces of the others meet in fewer blocks
in the next round, until one block is left, or a round no longer helps.

Defined results: a null text is empty: one piece with the end id alone (without an end id: one piece of length 0);
rows without an id are left out; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import runs, slices
from .shared import parts, stage
from .tokens import CACHED, definition, encoder

#: Pieces in a block; islands, groupings on an island, generations between migrations, rounds of them.
BLOCK, ISLANDS, GROUPINGS, GENERATIONS, EPOCHS = 2000, 2, 4, 16, 3
#: A bin that lacks at most this share of the length is final.
SLACK = 1 / 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Grouping:
    """Bins of pieces. Open bins are found by room: ``rooms`` has a bit for each room that some bin has."""

    def __init__(self, sizes: list[int], most: int):
        self.sizes, self.most = sizes, most
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def copy(self) -> Grouping:
        out = Grouping(self.sizes, self.most)
        out.bins, out.room = self.bins[:], self.room[:]  # bins are replaced, never changed
        return out

    def best_fit(self, pieces: list[int]) -> None:
        by_room: dict[int, list[int]] = {}
        mask = 0
        for i, r in enumerate(self.room):
            by_room.setdefault(r, []).append(i)
            mask |= 1 << r
        for p in pieces:
            n = self.sizes[p]
            able = mask >> n
            if able:
                r = n + (able & -able).bit_length() - 1
                at = by_room[r].pop()
                if not by_room[r]:
                    mask &= ~(1 << r)
            else:
                r, at = self.most, len(self.bins)
                self.bins.append([])
                self.room.append(r)
            self.bins[at] = [*self.bins[at], p]
            r -= n
            self.room[at] = r
            by_room.setdefault(r, []).append(at)
            mask |= 1 << r

    def drop(self, bad: set[int]) -> list[int]:
        """Dissolve bins; their pieces."""
        loose = [p for b in bad for p in self.bins[b]]
        keep = [i for i in range(len(self.bins)) if i not in bad]
        self.bins, self.room = [self.bins[i] for i in keep], [self.room[i] for i in keep]
        return loose

    def value(self) -> tuple[int, float]:
        """Fewer bins are better, then uneven filling (mean square)."""
        return -len(self.bins), sum((self.most - r) ** 2 for r in self.room) / max(1, len(self.room))


def founders(sizes: list[int], most: int, rng: random.Random) -> list[Grouping]:
    """Groupings to begin with: best-fit of the pieces in random order, larger ones likelier to come early."""
    out = []
    for _ in range(GROUPINGS):
        g = Grouping(sizes, most)
        g.best_fit(sorted(range(len(sizes)), key=lambda p: -sizes[p] * rng.random()))
        out.append(g)
    return out


def crossover(a: Grouping, b: Grouping, rng: random.Random) -> Grouping:
    """A child of ``a`` with some of the fullest bins of ``b``."""
    sizes, most = a.sizes, a.most
    child = a.copy()
    good = sorted(range(len(b.bins)), key=lambda i: b.room[i])[: max(1, len(b.bins) // 2)]
    gifts = [b.bins[i] for i in rng.sample(good, max(1, len(good) // rng.choice((2, 4, 8))))]
    given = {p for g in gifts for p in g}
    loose = [p for p in child.drop({i for i, x in enumerate(child.bins) if not given.isdisjoint(x)}) if p not in given]
    child.bins += gifts
    child.room += [most - sum(sizes[p] for p in g) for g in gifts]
    open_ = sorted(range(len(child.bins)), key=lambda i: -child.room[i])[: max(2, len(child.bins) // 4)]
    loose += child.drop(set(rng.sample(open_, max(1, len(open_) // rng.choice((1, 2, 4))))))  # mutation
    child.best_fit(sorted(loose, key=lambda p: -sizes[p] * rng.uniform(0.9, 1.0)))
    return child


def generations(island: list[Grouping], rng: random.Random, turns: int = GENERATIONS) -> list[Grouping]:
    """The island after so many generations, the best grouping first; fewer once one has the least number of bins there can be."""
    sizes, most = island[0].sizes, island[0].most
    bound = -(-sum(sizes) // most)
    island = sorted(island, key=Grouping.value, reverse=True)
    for _ in range(turns):
        if len(island[0].bins) <= bound or len(island) < 2:
            break
        a, b = sorted(rng.sample(range(len(island)), 2))
        child = crossover(island[a], island[b], rng)
        if child.value() > island[-1].value():
            island[-1] = child
            island.sort(key=Grouping.value, reverse=True)
    return island


def evolve(sizes: list[int], most: int, seed: int) -> Grouping:
    """What the islands of a block find together, in one process. Sizes are at most ``most``; every piece is there once."""
    islands = [founders(sizes, most, random.Random(seed * 31 + k)) for k in range(ISLANDS)]
    for epoch in range(EPOCHS):
        if epoch:
            guests = [island[0] for island in islands]
            islands = [[*island[:-1], guests[k - 1]] for k, island in enumerate(islands)]
        islands = [generations(island, random.Random(seed * 1009 + epoch * 31 + k)) for k, island in enumerate(islands)]
    return max((island[0] for island in islands), key=Grouping.value)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with n ids."""
    if n <= most:
        return [(0, n)]
    head = n % most
    return [(0, head)] * bool(head) + [(at, most) for at in range(head, n, most)]


def pieces(docs: DataFrame, tokenizer: str, most: int, end_id: int | None, id_col: str, text_col: str, cached: int) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(definition(tokenizer))
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in slices(batches, most=(1 if cached < CACHED else 4) << 20, keep="tokens"):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"), cached)):
                ids += tail
                rows += [(doc_id, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, most))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, PIECES)


def _written(g: Grouping) -> bytes:
    """The bin of each piece."""
    out = np.zeros(len(g.sizes), "<i4")
    for k, b in enumerate(g.bins):
        out[b] = k
    return out.tobytes()


def _read(data: bytes, sizes: list[int], most: int) -> Grouping:
    g = Grouping(sizes, most)
    which = np.frombuffer(data, "<i4")
    order = np.argsort(which, kind="stable")
    edges = np.searchsorted(which[order], np.arange((int(which.max()) + 2) if len(which) else 1))
    g.bins = [order[a:e].tolist() for a, e in zip(edges[:-1], edges[1:])]
    g.room = [most - sum(sizes[p] for p in b) for b in g.bins]
    return g


#: A block's pieces in order, packed: a row each.
BLOCKS = "block int, docs binary, pieces binary, starts binary, lengths binary, crcs binary"
KINDS = {"docs": ("doc_id", "<i8"), "pieces": ("piece", "<i4"), "starts": ("start", "<i8"), "lengths": ("length", "<i8"), "crcs": ("ids_crc32", "<i8")}
ISLAND = "block int, island int, lengths binary, groupings array<binary>, bins int, fill double"


def _gather(table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("piece", "ascending")]))
    return pa.table({"block": table["block"][:1], **{k: pa.array([table[c].to_numpy().astype(t).tobytes()], pa.binary()) for k, (c, t) in KINDS.items()}})


def _epoch(most: int, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round of generations on each island of the batches (block, island, lengths, groupings, guest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes = np.frombuffer(r["lengths"], "<i8").tolist()
                rng = random.Random(r["block"] * 1009 + r["island"] * 31 + turn)
                island = [_read(g, sizes, most) for g in r["groupings"]] if r["groupings"] else founders(sizes, most, rng)
                if r["guest"] is not None:
                    island = [*island[:-1], _read(r["guest"], sizes, most)]
                island = generations(island, rng)
                value = island[0].value()
                row = (r["block"], r["island"], r["lengths"], [_written(g) for g in island], -value[0], value[1])
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.float64()))], [c.split()[0] for c in ISLAND.split(", ")])

    return run


def evolved(blocks: DataFrame, most: int, turn: int) -> DataFrame:
    """(block, best): the best grouping that the islands of each block found."""
    n = parts(blocks)
    first = blocks.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")).select("block", "island", "lengths", F.lit(None).cast("array<binary>").alias("groupings"), F.lit(None).cast("binary").alias("guest"))
    state = stage(first.repartition(n, "block", "island").mapInArrow(_epoch(most, turn * 16), ISLAND), "islands")
    for k in range(1, EPOCHS):  # the best of each island goes to the next; small rows, one for each island
        guests = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("groupings", 1).alias("guest"))
        met = state.select("block", "island", "lengths", "groupings").join(guests, ["block", "island"]).select("block", "island", "lengths", "groupings", "guest")
        state = stage(met.repartition(n, "block", "island").mapInArrow(_epoch(most, turn * 16 + k), ISLAND), "islands")
    return state.groupBy("block").agg(F.max_by(F.element_at("groupings", 1), F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("best"))


def _placed(most: int, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each piece of the batches' blocks, with its bin and place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = {c: np.frombuffer(r[k], t) for k, (c, t) in KINDS.items()}
                number, size = np.frombuffer(r["best"], "<i4"), columns["length"]
                order = np.argsort(number, kind="stable")
                end = np.cumsum(size[order])
                first = runs(number[order])
                begin = np.repeat((end - size[order])[first], np.diff(np.append(first, len(order))))
                offset, fill = np.zeros(len(size), np.int64), np.bincount(number, size, int(number.max()) + 1).astype(np.int64)[number]
                offset[order] = end - size[order] - begin
                same = lambda v: np.full(len(size), v, np.int32)
                more = {"round": same(turn), "block": same(r["block"]), "bin": number, "fill": fill, "offset": offset}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns.values(), *more.values())], [*columns, *more])

    return run


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, cached: int = CACHED) -> DataFrame:
    """One row for each piece, with its sequence and its place there. cached: words that a worker's tokenizer cache holds."""
    every = stage(pieces(docs, tokenizer, most, end_id, id_col, text_col, cached), "pieces")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = f"{PIECES}, round int, block int, bin int, fill long, offset long"
    # a full piece is a sequence; equal rows' pieces differ by their place in the partition, which is fixed in the written table
    full = every.where(F.col("length") >= most).select(*names, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, done, turn = every.where(F.col("length") < most), [], 0
    count = left.count()
    while True:
        n_blocks = max(1, -(-count // block))
        dealt = left.select(*names, F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(n_blocks)).cast("int").alias("block"))
        blocks = stage(dealt.groupBy("block").applyInArrow(_gather, BLOCKS), "blocks")
        packed = stage(blocks.join(evolved(blocks, most, turn), "block").mapInArrow(_placed(most, turn), kind), "packed")
        open_ = F.col("fill") < int(most * (1 - SLACK))
        before, count = count, 0 if n_blocks == 1 else packed.where(open_).count()
        if n_blocks == 1 or count > 0.7 * before:
            done.append(packed)
            break
        done.append(packed.where(~open_))
        left, turn = packed.where(open_), turn + 1
    sequence = (F.col("round").cast("long") * (1 << 56)) + F.col("block").cast("long") * (1 << 24) + F.col("bin")
    return reduce(DataFrame.unionByName, done).select(*names, sequence.alias("sequence_id"), "offset").unionByName(full)
