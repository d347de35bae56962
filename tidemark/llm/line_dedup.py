"""Line dedup by a segment-partition edit join.

A line is a repeat if an earlier line (by document id, then place) is within ``edits`` edits of it, or connected with it
by such lines. Lines of fewer than ``least`` code points are only compared for equality, and only with ``short``; blank
lines are left alone. A line is cut into edits + 1 segments; two lines
within that distance agree in one of them, at nearly the same place. So every line probes, for each length it may meet,
the substrings at which that length's segments can lie (the multi-match-aware windows). Keys are (length, segment,
content); a line's own segments are among its probes. Members of a key are compared by the parity of their pairs of code
points (an edit flips at most four bits of it), which only drops pairs that are too far apart; what stays connected
are candidate clusters, verified by a banded bit-parallel edit distance.

Defined results: a null text has no lines and stays null; the newlines between kept lines stay; equal lines are
repeats like others; a distance equal to the threshold counts; exactly repeated rows are one document; rows without an
id are left out; an empty table gives an empty result. Lines are told apart by a 64-bit hash of their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import candidate_edges, components, exact_links
from .hashing import U, Words, mix, slices
from .shared import maybe_in, reclaim, stage, unpacked, whole_row

EDITS, LEAST = 2, 30


class Lines:
    """Lines of a batch of texts of at least ``least`` code points: row, number in the text, bytes, code points, hash."""

    def __init__(self, texts: pa.Array, least: int):
        w = self.w = Words(texts)
        raw, off = w.raw, w.offsets
        newline = np.flatnonzero(raw == 10)
        some = np.flatnonzero(np.diff(off) > 0)
        begin = np.concatenate([off[:-1][some], newline + 1])
        row = np.concatenate([some, np.searchsorted(off, newline, "right") - 1])
        order = np.lexsort((begin, row))
        begin, row = begin[order], row[order]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        end = np.where(last, off[row + 1], np.append(begin[1:], 0)[: len(row)] - 1)
        starts = np.concatenate([[0], np.flatnonzero(np.append(True, row[1:] != row[:-1]))[1:]]) if len(row) else np.zeros(0, np.int64)
        number = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row)))) if len(row) else begin
        head = (raw & 0xC0) != 0x80
        self.points = np.flatnonzero(head)  # where code points begin
        index = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(head, out=index[1:])
        length = index[end] - index[begin]
        keep = length >= least
        self.row, self.number, self.begin, self.end, self.length = row[keep], number[keep].astype(np.int32), begin[keep], end[keep], length[keep]
        self.first = index[self.begin]  # code point with which the line begins
        self.id = (w.hash_of(self.begin, self.end) >> U(1)).view(np.int64)
        self.points = np.append(self.points, len(raw))

    def parity(self) -> np.ndarray:
        """For each line the parity of its pairs of code points, as 64 bits: an edit changes at most four of them, two that
        go and two that come."""
        raw, at = self.w.raw, self.points[:-1]
        code = raw[at].astype(U)
        size = np.diff(self.points)
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            code[more] |= raw[at[more] + k].astype(U) << U(8 * k)
        pair = np.zeros(len(at) + 1, U)
        if len(at) > 1:
            pair[1:-1] = U(1) << (mix((code[:-1] << U(32)) | code[1:]) >> U(58))
        total = np.concatenate([np.zeros(1, U), np.bitwise_xor.accumulate(pair)])
        end = self.first + self.length
        return total[end] ^ total[np.minimum(self.first + 1, end)]

    def blank(self) -> np.ndarray:
        """Whether each line has only ASCII white space."""
        raw = self.w.raw
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw != 32) & ((raw < 9) | (raw > 13)), out=total[1:])
        return total[self.end] == total[self.begin]

    def take(self, keep: np.ndarray) -> None:
        for name in ("row", "number", "begin", "end", "length", "first", "id"):
            setattr(self, name, getattr(self, name)[keep])


def cuts(length: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(begin, length) of the segments of lines of these lengths: the longer ones last."""
    short, longer = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at = at + size
    return out


def probes(lines: Lines, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every substring that a line of some length could have as a segment."""
    who, keys = [], []
    for shift in range(edits + 1):  # the other line is shorter by so much, or as long
        other = lines.length - shift
        for i, (at, size) in enumerate(cuts(other, edits + 1)):
            lo = max(-i, shift - (edits - i))
            hi = min(i, shift + (edits - i))
            for move in range(lo, hi + 1):
                begin = at + move
                fine = np.flatnonzero((begin >= 0) & (begin + size <= lines.length) & (size > 0) & (other > 0))
                a = lines.points[lines.first[fine] + begin[fine]]
                b = lines.points[lines.first[fine] + begin[fine] + size[fine]]
                who.append(fine)
                keys.append(mix(lines.w.hash_of(a, b) ^ mix((other[fine] * 16 + i).astype(U))))
    return np.concatenate(who), np.concatenate(keys)


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: a set of diagonals for each number of edits, as bits."""
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    lo = 0
    if a[:n] != b[:n]:
        step = n
        while step:  # length of the common prefix
            if a[lo : lo + step] == b[lo : lo + step] and lo + step <= n:
                lo += step
            step //= 2
        while lo < n and a[lo] == b[lo]:
            lo += 1
    else:
        return True
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    band = (1 << (2 * edits + 1)) - 1
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << (i + edits))
    state = [(((1 << (e + 1)) - 1) << edits) & band for e in range(edits + 1)]
    for j, c in enumerate(b):
        match = (at.get(c, 0) >> j) & band
        new = [state[0] & match]
        for e in range(1, edits + 1):
            new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> 1) | (new[e - 1] << 1)) & band)
        state = new
        if not state[-1]:
            return False
    return bool(state[-1] >> (len(a) - len(b) + edits) & 1)


def occurrences(rows: DataFrame, least: int, short: bool) -> DataFrame:
    """(doc_id, tag, number, line) of the lines of at least ``least`` code points; with ``short``, of all that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = Lines(b.column("text"), 1 if short else least)
            if short:
                x.take(~x.blank() | (x.length >= least))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(b.column(c))[x.row]) for c in ("doc_id", "tag")] + [pa.array(x.number), pa.array(x.id)], ["doc_id", "tag", "number", "line"])

    return rows.mapInArrow(run, "doc_id long, tag long, number int, line long")


def line_texts(rows: DataFrame, least: int) -> DataFrame:
    """(line, payload): lines with their text, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=8 << 20):
            seen: set[int] = set()
            for s in slices(iter([b])):
                x = Lines(s.column("text"), least)
                _, one = np.unique(x.id, return_index=True)
                x.take(one)
                x.take(np.array([i not in seen for i in x.id.tolist()], bool))
                seen.update(x.id.tolist())
                data = x.w.raw.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(x.id), pa.array([data[p:q].decode() for p, q in zip(x.begin.tolist(), x.end.tolist())], pa.string())], ["line", "payload"])

    return rows.select("text").mapInArrow(run, "line long, payload string")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST, cap: int = 1000, short: bool = False) -> DataFrame:
    """(doc_id, tag, gone): numbers of the lines that repeat an earlier one; tag is a hash of the row's text.
    ``short``: lines of fewer than ``least`` code points repeat those that equal them."""
    if least < edits + 1:
        raise ValueError("lines must be at least edits + 1 long")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").withColumn("tag", F.xxhash64("text"))

    def emit(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, ids, sketches = [], [], []
        for s in slices(iter([b])):
            x = Lines(s.column("text"), least)
            _, one = np.unique(x.id, return_index=True)
            x.take(one)
            who, key = probes(x, edits)
            keys.append(key)
            ids.append(x.id[who])
            sketches.append(x.parity()[who])
        keys, ids, sketches = (np.concatenate(c) for c in (keys, ids, sketches))
        # a line that the batch has again gives the same rows
        order = np.lexsort((ids, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[new]
        return keys[order], ids[order], sketches[order][:, None]

    most = 4 * edits

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a ^ b).sum(-1) <= most

    edges = stage(candidate_edges(rows.select("text"), emit, alike, lambda batches: slices(batches, most=8 << 20)).where("src <> dst"), "line-candidates")
    reclaim(spark)
    clusters = stage(components(edges), "line-clusters")
    near = maybe_in(clusters, "node")  # most lines are in no cluster
    members = near(line_texts(rows, least), "line", "_near").where("_near").join(clusters, F.col("line") == F.col("node")).groupBy(F.col("component").alias("cluster"), F.col("line").alias("id")).agg(F.any_value("payload").alias("payload"))
    links = exact_links(members, lambda table: table["payload"].to_pylist(), lambda what, x, rest: np.array([within(what[x], what[y], edits) for y in rest.tolist()], bool), cap)
    reclaim(spark)
    comp = components(links)
    places = stage(occurrences(rows, least, short), "lines")
    keyed = places.join(comp, F.col("line") == F.col("node"), "left").select("doc_id", "tag", "number", F.coalesce("component", "line").alias("key"))
    keyed = stage(keyed, "places")
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "tag", "number")).alias("f"), F.count("*").alias("c")).where("c > 1").select("key", "f")
    gone = keyed.join(first, "key").where(F.struct("doc_id", "tag", "number") != F.col("f")).groupBy("doc_id", "tag").agg(F.collect_set("number").alias("gone"))
    gone = stage(gone, "gone")
    reclaim(spark)
    return gone


def _edited(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, n_lines, n_removed): each row of docs as it is, and its text without its repeated lines."""
    text = F.col("row").getField(text_col).cast("string")  # from the packed row, so that it travels once
    keyed = docs.select(whole_row(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: ~F.array_contains("gone", x.i)).t, "\n")
    marked = maybe_in(gone, "doc_id")(keyed, "id", "some")
    marks = gone.select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), "gone")
    hit = marked.where("some").join(marks, (F.col("id") == F.col("g_id")) & (F.xxhash64(text) == F.col("g_tag")), "left").select("row", "id", "gone")
    plain = hit.unionByName(marked.where("not some").select("row", "id", F.lit(None).cast("array<int>").alias("gone")))
    counts = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in ((lines, "n_lines"), (F.col("gone"), "n_removed"))]
    return plain.select("row", "id", F.when(F.col("gone").isNull(), text).otherwise(kept).alias("text"), *counts)


def without_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns, with the text of each row without its repeated lines; ``length_col`` follows in code points."""
    changed = {text_col: F.col("text")}
    if length_col in docs.columns:
        changed[length_col] = F.length("text").cast("long")
    return unpacked(_edited(docs, gone, id_col, text_col), "row", docs.columns, **changed)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text): every row without the lines that repeat an earlier one."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    out = _edited(rows, repeated_lines(rows, **options), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.col("text").alias("kept_text"))
