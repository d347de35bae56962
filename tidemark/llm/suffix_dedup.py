"""Substring dedup by prefix-partitioned suffix trees over words.

A passage is removed where its words also start in a document with a smaller id. Suffixes are words' positions; a
suffix counts by its first ``n`` words. The work has three steps.

1. Anchors. In every window of n words the least of its ``ANCHOR``-word hashes is its anchor, so equal windows have equal
   anchors, and about one position in five is one. Anchors that only one document has cannot belong to a repeat. They
   are matched in packed buckets, and so are the segments of text round them, by the hash of their bytes: of equal segments
   only the least id's goes into a tree, and in the others, ``covered``, every window is a repeat. A task passes on one
   document for each segment, however many copies it holds, and one for each anchor with more than ``UNLIKE`` segments there.
2. Trees. Only suffixes round shared anchors are built. Their segments are dealt into groups by a
   prefix of the anchor's suffix, of as many words as it takes (1, 2, 4, 5) for at most ``GROUP`` segments to share it;
   never of more than the anchor's words, since those that follow may lie past the passage. There are as many groups as
   the segments' number asks for, of about ``SEGMENTS`` each, whatever the session's partitions. Of a prefix still too
   heavy at five words, each window counts by itself, by all its words. In a group all suffixes of the segments, to the
   segments' ends, are sorted word by word (by doubled prefixes), and the common prefixes of neighbours give the suffix
   tree's internal nodes. A node at least n words deep is a repeat; every node knows its least document id, and the
   deepest node above a suffix that has a smaller id tells how long the repeat is that starts there.
3. Removal. The repeats, without those inside others, go back to their documents as places and lengths.

Defined results: a null text has no words; a document with fewer than n words keeps all; rows without an id are left
out; rows with the same id are told apart by their text, and are never copies of each other (no smaller id); an empty
table gives an empty result. Words are the runs of other than the six ASCII white spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, mix, runs, slices
from .shared import maybe_in, parts, reclaim, stage

#: Words of the anchors' hashes. Segments that share a prefix, beyond which it grows; segments in a group, on average.
ANCHOR, GROUP, SEGMENTS = 5, 25_000, 40_000
#: The lengths that prefixes grow through.
PREFIXES = (1, 2, 4, ANCHOR)
#: Segments with one anchor that a task passes on from a slice of texts; of more, one, so that no anchor gathers in a bucket.
UNLIKE = 64
#: Places of shared anchors; the hash of the segment there if a smaller id has it too, else 0.
MARK = np.dtype([("at", "<i4"), ("same", "<u8")])
#: Heavy prefixes of a level that are broadcast; more are joined.
LISTED = 1_000_000


def anchors(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: (word index, hash, first window, windows) of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    at, h = w.windows(w.hashes(), ANCHOR)
    span = n - ANCHOR + 1
    total = len(at) - span + 1
    if total <= 0:
        return none, np.zeros(0, U), none, none
    best, where = h[:total].copy(), np.zeros(total, np.int64)
    for k in range(1, span):  # the last of equal ones, so that equal windows agree
        better = h[k : k + total] <= best
        best[better] = h[k : k + total][better]
        where[better] = k
    row = w.doc[at]
    window = np.flatnonzero(row[:total] == row[span - 1 :])
    chosen = (window + where[window]) if len(window) else none
    begin = runs(chosen)
    return at[chosen[begin]], h[chosen[begin]], at[window[begin]], np.diff(np.append(begin, len(chosen)))


def _by_key(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (key, id), where keys begin there, and for each row there whether its key has more than one id."""
    order = np.lexsort((ids, keys))
    begin = runs(keys[order])
    size = np.diff(np.append(begin, len(keys)))
    lo, hi = ids[order][begin], ids[order][begin + size - 1]
    return order, begin, np.repeat(lo != hi, size)


def _covered(keys: np.ndarray, whole: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row whether a smaller id has the same (key, segment)."""
    order = np.lexsort((ids, whole, keys))
    keys, whole, own = keys[order], whole[order], ids[order]
    new = np.ones(len(own), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(own), bool)
    out[order] = own > np.repeat(own[begin], np.diff(np.append(begin, len(own))))
    return out


def _arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(b.column(c)) for c in names]


def segment_hashes(w: Words, first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Of the bytes from the first word of each run of windows to its last."""
    return w.hash_of(w.start[first], w.end[first + count + n - 2]) if len(first) else np.zeros(0, U)


def shared_anchors(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, at): anchors (``MARK``, packed) that more than one document has, by document."""
    buckets = parts(rows) * 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4 << 20):
            got: list[tuple] = []
            for s in slices(iter([b])):
                w = Words(s.column("text"))
                at, h, first, count = anchors(w, n)
                row = w.doc[at]
                got.append((h, _arrays(s, "doc_id")[0][row], (at - w.first[row]).astype(np.int32), segment_hashes(w, first, count, n)))
            key, doc, pos, whole = (np.concatenate(x) for x in zip(*got))
            if not len(key):
                continue
            order, begin, shared = _by_key(key, doc)
            key, doc, pos, whole = key[order], doc[order], pos[order], whole[order]
            some = np.flatnonzero(shared)
            covered = np.zeros(len(key), bool)
            covered[some] = _covered(key[some], whole[some], doc[some])
            # of the documents that share an anchor here, one of each segment goes on; anchors of one document all do
            new = shared & ~covered
            many = np.repeat(np.add.reduceat(new, begin, dtype=np.int64), np.diff(np.append(begin, len(key)))) > UNLIKE
            onward = ~shared | (new & ~many)
            onward[begin] = True
            bucket = np.where(onward, (key >> U(40)).astype(np.int64), doc & 0x7FFFFFFF) % buckets
            o = np.lexsort((pos, doc, bucket))
            edges = np.searchsorted(bucket[o], np.arange(buckets + 1))
            flags = (shared + 2 * onward + 4 * covered).astype(np.uint8)
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i = o[edges[k] : edges[k + 1]]
                ids = np.diff(doc[i], prepend=0)
                out.append((k, key[i].tobytes(), ids.tobytes(), pos[i].tobytes(), flags[i].tobytes(), whole[i].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 5))], ["bucket", "key", "doc", "pos", "flags", "whole"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in table[c]]
        key, pos, flags, whole = (np.concatenate(read(c, t)) for c, t in (("key", np.uint64), ("pos", np.int32), ("flags", np.uint8), ("whole", np.uint64)))
        doc = np.concatenate([np.cumsum(x) for x in read("doc", np.int64)])
        found, covered = (flags & 1) == 1, (flags & 4) == 4
        on = np.flatnonzero(flags & 2)
        order, _, shared = _by_key(key[on], doc[on])
        met = on[order[shared]]
        found[met] = True
        covered[met] |= _covered(key[met], whole[met], doc[met])
        mark = np.empty(int(found.sum()), MARK)
        mark["at"], mark["same"], doc = pos[found], np.where(covered, whole, U(0))[found], doc[found]
        order = np.lexsort((mark["at"], doc))
        doc, mark = doc[order], mark[order]
        begin = runs(doc)
        return pa.table({"doc_id": doc[begin], "at": pa.array([mark[a:e].tobytes() for a, e in zip(begin, np.append(begin[1:], len(doc)))], pa.binary())})

    packed = rows.select("doc_id", "text").mapInArrow(send, "bucket int, key binary, doc binary, pos binary, flags binary, whole binary")
    return packed.groupBy("bucket").applyInArrow(meet, "doc_id long, at binary")


SEGMENT = ["doc_id long", "tag long", "begin int", "windows int", "covered boolean", "words binary", *[f"p{k} long" for k in range(len(PREFIXES))]]


def prefixes(w: Words, at: np.ndarray) -> list[np.ndarray]:
    """For each of PREFIXES the hash of that many words from each anchor on."""
    out, acc = [], np.zeros(len(at), U)
    for j in range(ANCHOR):
        acc = mix(acc * U(31) + w.hash_of(w.start[at + j], w.end[at + j]))
        if j + 1 in PREFIXES:
            out.append(acc.view(np.int64))
    return out


def segments(rows: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The text of each run of windows with a shared anchor, and prefixes of the anchor's suffix. ``covered``: a smaller
    id has the same segment, so all its windows are repeats, and its text need not travel; such runs that follow one another
    are one row."""
    names = [x.split()[0] for x in SEGMENT]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), *[pa.int64()] * len(PREFIXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            w = Words(s.column("text"))
            at, _, first, count = anchors(w, n)
            marks = [np.frombuffer(b"".join(x.as_py()), MARK) for x in s.column("at")]
            place = np.concatenate([m["at"].astype(np.int64) + f for m, f in zip(marks, w.first)])
            same = np.concatenate([m["same"] for m in marks])
            order = np.argsort(place, kind="stable")
            place, same = place[order], same[order]
            keep = np.isin(at, place)
            at, first, count = at[keep], first[keep], count[keep]
            if not len(at):
                continue
            whole, lo, hi = segment_hashes(w, first, count, n), np.searchsorted(place, at), np.searchsorted(place, at, "right")
            covered = np.zeros(len(at), bool)
            for k in range(int((hi - lo).max())):  # texts with one id have each other's marks too
                covered |= (lo + k < hi) & (same[np.minimum(lo + k, hi - 1)] == whole) & (whole != 0)
            data, (doc, tag) = w.raw.tobytes(), _arrays(s, "doc_id", "tag")
            loose, gone = np.flatnonzero(~covered), np.flatnonzero(covered)
            joined = np.ones(len(gone), bool)
            joined[1:] = (w.doc[at[gone[1:]]] != w.doc[at[gone[:-1]]]) | (first[gone[1:]] != first[gone[:-1]] + count[gone[:-1]])
            begin = np.flatnonzero(joined)
            total = np.add.reduceat(count[gone], begin) if len(gone) else count[gone]
            gone = gone[begin]
            for i, windows, text, pre in (
                (loose, count[loose], [data[a:e] for a, e in zip(w.start[first[loose]].tolist(), w.end[first[loose] + count[loose] + n - 2].tolist())], prefixes(w, at[loose])),
                (gone, total, [None] * len(gone), [np.zeros(len(gone), np.int64)] * len(PREFIXES)),
            ):
                if len(i):
                    row = w.doc[at[i]]
                    own = (doc[row], tag[row], (first[i] - w.first[row]).astype(np.int32), windows.astype(np.int32), covered[i], text, *pre)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, kinds)], names)

    by_doc = found.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    some = maybe_in(found, "doc_id")(rows, "doc_id", "hit").where("hit").drop("hit")
    return some.join(by_doc, "doc_id").select("doc_id", "tag", "text", "at").mapInArrow(run, ", ".join(SEGMENT))


def grouped(some: DataFrame, group: int = GROUP) -> DataFrame:
    """Segments with a group each: by the shortest prefix that at most ``group`` segments share, or the longest there is.
    ``heavy``: more than ``group`` segments share that one too."""
    spark, last = some.sparkSession, len(PREFIXES) - 1
    kept = ["doc_id", "tag", "begin", "windows", "words"]
    # a level has at most (segments / group) heavy prefixes
    many = [stage(some.groupBy(f"p{k}").agg(F.count("*").alias("c")).where(F.col("c") > group).select(f"p{k}", F.lit(True).alias(f"h{k}")), "heavy") for k in range(last + 1)]
    if max(m.count() for m in many) > LISTED:
        marked = some
        for k, m in enumerate(many):
            marked = marked.join(m, f"p{k}", "left")
        key = F.col(f"p{last}")
        for k in range(last - 1, -1, -1):  # a prefix is heavy only if those shorter are
            key = F.when(F.col(f"h{k}").isNull(), F.col(f"p{k}")).otherwise(key)
        return marked.select(*kept, key.alias("prefix"), F.col(f"h{last}").isNotNull().alias("heavy"))
    shared = spark.sparkContext.broadcast([m.toArrow()[f"p{k}"].to_numpy() for k, m in enumerate(many)])  # at most LISTED each

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _arrays(b, *[f"p{k}" for k in range(last + 1)])
            heavy = [np.isin(x, listed) for x, listed in zip(p, shared.value)]
            key = p[last]
            for k in range(last - 1, -1, -1):
                key = np.where(heavy[k], key, p[k])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(key), pa.array(heavy[last])], [*kept, "prefix", "heavy"])

    return some.select(*kept, *[f"p{k}" for k in range(last + 1)]).mapInArrow(deal, "doc_id long, tag long, begin int, windows int, words binary, prefix long, heavy boolean")


def heavy_repeats(heavy: DataFrame, n: int) -> DataFrame:
    """(doc_id, tag, begin, windows): windows, one a row, that a smaller id has too. Windows meet by all their n words, and
    the least id of each is a partial aggregate, so neither a heavy prefix nor a heavy window gathers in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            least: dict[bytes, int] = {}
            doc, tag, begin, windows = (x.tolist() for x in _arrays(b, "doc_id", "tag", "begin", "windows"))
            for d, t, base, c, text in zip(doc, tag, begin, windows, b.column("words").to_pylist()):
                own = text.split()
                for i in range(c):
                    window = b" ".join(own[i : i + n])
                    if least.get(window, d) >= d:
                        least[window] = d
                    out.append((d, t, base + i, window))
            if out:  # what a smaller id of the batch has is a repeat already
                final = [(d, t, i, None if d > least[window] else window) for d, t, i, window in out]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*final), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "tag", "begin", "window"])

    single = stage(heavy.select("doc_id", "tag", "begin", "windows", "words").mapInArrow(run, "doc_id long, tag long, begin int, window binary"), "windows")
    met = single.where("window is not null")
    least = met.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "least")
    again = met.join(least, "window").where("doc_id > least").select("doc_id", "tag", "begin")
    return again.unionByName(single.where("window is null").select("doc_id", "tag", "begin")).withColumn("windows", F.lit(1))


class Tree:
    """The suffix tree of segments (lists of words): suffixes in order, and common prefixes of neighbours.

    A segment ends in a terminator of its own. Ranks by the first 1, 2, 4, ... words come from ranks of pairs, until they
    reach over the longest segment; two suffixes' common prefix comes from the same ranks, the longest first."""

    def __init__(self, words: list[bytes], windows: np.ndarray):
        """windows: of each segment, how many of its first suffixes are in the tree."""
        names: dict[bytes, int] = {}
        flat: list[int] = []
        begin, longest = np.zeros(len(words), np.int64), 1
        for k, text in enumerate(words):
            own = text.split()
            begin[k], longest = len(flat), max(longest, len(own) + 1)
            flat.extend([names.setdefault(x, len(names)) for x in own])
            flat.append(-1)
        code = np.array(flat, np.int64)
        ends = np.flatnonzero(code < 0)
        code[ends] = len(names) + np.arange(len(ends))
        self.code, self.size = code, len(code)
        self.owner = np.repeat(np.arange(len(windows)), windows)  # segment of each suffix
        self.inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = begin[self.owner] + self.inside
        self.ranks, k = [code], 1
        while k < longest:
            last = self.ranks[-1]
            pair = last * (self.size + len(names) + 1)
            pair[: self.size - k] += last[k:] + 1
            self.ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
            k *= 2
        self.order = np.argsort(self.ranks[-1][self.at], kind="stable")
        self.lcp = self.common(self.at[self.order[:-1]], self.at[self.order[1:]]) if len(self.order) > 1 else np.zeros(0, np.int64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b begin with together."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            inside = np.maximum(a, b) < self.size
            same = np.zeros(len(a), bool)
            same[inside] = self.ranks[level][a[inside]] == self.ranks[level][b[inside]]
            step = same.astype(np.int64) << level
            out, a, b = out + step, a + step, b + step
        return out

    def nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(depth, first, end) of every internal node at least so deep: its suffixes are order[first:end]."""
        out = []
        for depth in range(max(1, least), int(self.lcp.max(initial=0)) + 1):
            cut = np.concatenate([[0], np.flatnonzero(self.lcp < depth) + 1, [len(self.order)]])
            first, end = cut[:-1], cut[1:]
            many = end - first > 1
            first, end = first[many], end[many]
            if len(first):
                shallow = np.minimum.reduceat(np.append(self.lcp, depth + 1), np.stack([first, end - 1], 1).ravel())[::2]
                real = shallow == depth  # otherwise all its suffixes go on together
                out.append((np.full(real.sum(), depth), first[real], end[real]))
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (empty, empty, empty)

    def maximal(self, least: int) -> list[tuple[int, list[int]]]:
        """(words, places in code) of each maximal repeat: nodes whose suffixes do not all follow one word."""
        out = []
        for depth, first, end in zip(*(x.tolist() for x in self.nodes(least))):
            places = self.at[self.order[first:end]]
            before = [int(self.code[p - 1]) if p else -1 for p in places.tolist()]
            if len(set(before)) > 1:
                out.append((depth, sorted(places.tolist())))
        return out

    def repeated(self, ids: np.ndarray, least: int) -> np.ndarray:
        """For each suffix the depth of the deepest node above it that has a smaller id than its segment's; 0 if none
        at least so deep. On a path from the root the nodes' least ids only grow."""
        own = ids[self.owner[self.order]]
        deep = np.zeros(len(own), np.int64)
        for depth in range(least, int(self.lcp.max(initial=0)) + 1):
            cut = np.concatenate([[0], np.flatnonzero(self.lcp < depth) + 1])
            node = np.repeat(np.minimum.reduceat(own, cut), np.diff(np.append(cut, len(own))))
            deep[node < own] = depth
        out = np.empty(len(own), np.int64)
        out[self.order] = deep
        return out


def outer(segment: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which intervals (in order of place in each segment) reach beyond all before them in their segment."""
    if not len(segment):
        return np.zeros(0, bool)
    base = (np.cumsum(np.append(True, segment[1:] != segment[:-1])) - 1) << 32  # so that a running maximum starts anew
    end = base + place + length
    return np.append(True, end[1:] > np.maximum.accumulate(end)[:-1])


def repeats(some: DataFrame, n: int, group: int = GROUP, segments_: int = SEGMENTS) -> DataFrame:
    """(doc_id, tag, at): places and lengths (packed pairs) of the repeats that a smaller id has too, by document."""
    loose = some.where("not covered")
    groups = max(1, -(-loose.count() // segments_))
    buckets = max(groups, parts(some))

    def packed(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """Repeats by bucket of documents: a row for each bucket, however many documents."""
        bucket = (doc & 0x7FFFFFFF) % buckets
        order = np.lexsort((place, tag, doc, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some_ = np.flatnonzero(np.diff(edges))
        cut = [order[edges[k] : edges[k + 1]] for k in some_.tolist()]
        at = np.stack([place, length], 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(some_.astype(np.int32)), *[pa.array([x[i].tobytes() for i in cut], pa.binary()) for x in (doc, tag, at)]], ["bucket", "docs", "tags", "at"])

    def grow(table: pa.Table) -> pa.Table:
        doc, tag, begin, windows = (table[c].to_numpy() for c in ("doc_id", "tag", "begin", "windows"))
        tree = Tree(table["words"].to_pylist(), windows)
        deep = tree.repeated(doc, n)
        hit = np.flatnonzero(deep)
        hit = hit[outer(tree.owner[hit], tree.inside[hit], deep[hit])]
        owner = tree.owner[hit]
        return pa.Table.from_batches([packed(doc[owner], tag[owner], begin[owner] + tree.inside[hit], deep[hit])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, tag, begin, windows = _arrays(b, "doc_id", "tag", "begin", "windows")
                yield packed(doc, tag, begin, windows + (n - 1))

    def by_document(table: pa.Table) -> pa.Table:
        doc, tag, at = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table[c]]) for c, t in (("docs", np.int64), ("tags", np.int64), ("at", np.int64)))
        order = np.lexsort((at, tag, doc))
        doc, tag, at = doc[order], tag[order], at[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        first = np.flatnonzero(new)
        return pa.table({"doc_id": doc[first], "tag": tag[first], "at": pa.array([at[a:e].tobytes() for a, e in zip(first, np.append(first[1:], len(at)))], pa.binary())})

    kind = "bucket int, docs binary, tags binary, at binary"
    dealt = grouped(loose, group)
    heavy = dealt.where("heavy")
    light = dealt.where("not heavy").drop("heavy").withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups)))
    trees = light.repartition(groups, "group").groupBy("group").applyInArrow(grow, kind)  # about a group a task
    known = some.where("covered").select("doc_id", "tag", "begin", "windows")
    if not heavy.isEmpty():
        known = known.unionByName(heavy_repeats(heavy, n))
    covered = known.mapInArrow(whole, kind)
    return trees.unionByName(covered).groupBy("bucket").applyInArrow(by_document, "doc_id long, tag long, at binary")


def remove(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row, without the words under the repeats found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            w = Words(b.column("text"))
            step = np.zeros(len(w.start) + 1, np.int64)
            for base, at in zip(w.first.tolist(), b.column("at").to_pylist()):
                if at:
                    place, length = np.frombuffer(b"".join(at), np.int32).reshape(-1, 2).astype(np.int64).T
                    np.add.at(step, base + place, 1)
                    np.add.at(step, base + place + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            data, keep = w.raw.tobytes(), np.flatnonzero(~gone)
            edges = np.searchsorted(keep, w.first)
            text = [data[a:e] for a, e in zip(w.start[keep].tolist(), w.end[keep].tolist())]
            kept = [b" ".join(text[a:e]).decode() for a, e in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(w.per_doc(gone)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    by_doc = found.select("doc_id", "tag", F.array("at").alias("at"))
    some = maybe_in(found, "doc_id")(rows, "doc_id", "hit")  # the other texts stay where they are
    joined = some.where("hit").join(by_doc, ["doc_id", "tag"], "left").select("doc_id", "text", "at")
    return joined.unionByName(some.where("not hit").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("at"))).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every document without the passages that a smaller id has too."""
    if n < ANCHOR:
        raise ValueError(f"passages of at least {ANCHOR} words")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null").withColumn("tag", F.xxhash64("text"))
    found = stage(shared_anchors(rows, n), "anchors")
    reclaim(docs.sparkSession)
    some = stage(segments(rows, found, n), "segments")
    reclaim(docs.sparkSession)
    at = stage(repeats(some, n), "repeats")
    reclaim(docs.sparkSession)
    return remove(rows, at)
