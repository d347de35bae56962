"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the terms of the benchmark, weighted by document frequencies of the whole corpus. A
distributed randomised SVD gives their latent space: each task multiplies its passages by a fixed random matrix and
back, A'(A Omega); the sums, of the vocabulary's size, give the leading right singular vectors by a Nystroem step.
Benchmark items are rows of A too, with as much weight as the corpus. Windows of 16 and 32 words of every document are
projected and compared with all items by cosine (a stated query set against all rows, in blocks of items). Candidates
are all pairs from ``COSINE`` on, whatever words they share; windows with no weighted term have no direction and are none.
Those with too few words in common for any verdict fall out by a count; the others are verified: a longest common subsequence close to the whole item is a leak; a looser one, a
paraphrase, also needs the answer check: most of the words of the item's answer, or without one of its most telling terms.

Words are lower-cased runs of letters and digits; characters of scripts written without spaces are words each. Terms in
more than ``STOP`` of the corpus's eight-word blocks carry no weight, unless an item has too few others. A latent space
belongs to a block of items (``BLOCK_BYTES`` of text, which bounds its vocabulary); it only proposes candidates, and the
reported cosine is that of the block's space.

Defined results: null, empty and wordless texts match nothing; an item of fewer than ``LEAST_WORDS`` words or
``LEAST_TERMS`` distinct ones has no direction to search by, and is a leak only where its words stand together as they
are (cosine null); one of fewer than ``LEAST_EXACT`` cannot be told from common speech and is not searched; equal items are reported each;
repeated rows are reported once for each id and item; rows without an id are left out; an empty table on either side
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import NOT_ALNUM, Words, buffer_of, runs, slices, sums
from .shared import stage

BLOCK, SCALES, STOP = 8, (2, 4), 1e-3
RANK, COSINE = 256, 0.5
#: Text of the items that are searched at once: bounds the vocabulary that is broadcast.
BLOCK_BYTES = 2 << 20
LEAST_WORDS, LEAST_TERMS, LEAST_EXACT = 5, 3, 3
#: Shares of an item's words in order: from LEAK on a leak, from LOOSE on one if KEYS of its TELLING rarest terms are there.
LEAK, LOOSE, TELLING, KEYS = 0.75, 0.5, 8, 0.75
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, paraphrase boolean"


#: Scripts without spaces between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"


def words_of(texts: pa.Array) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.utf8_lower(texts)
    if (buffer_of(texts)[0] >= 0xE0).any():  # code points of three bytes and more
        texts = pc.replace_substring_regex(texts, UNSPACED, r" \1 ")
    return Words(texts, NOT_ALNUM)


def lcs(a: dict[object, int], size: int, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel. a: bits of each word's places."""
    full = (1 << size) - 1
    row = full
    for x in b:
        u = row & a.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


class Items:
    """Benchmark items with the vocabulary that tells them apart."""

    def __init__(self, ids: list[int], texts: pa.Array, answers: pa.Array | None = None):
        h = self.split(texts)
        use = [i for i, x in enumerate(h) if len(x) >= LEAST_WORDS and len(np.unique(x)) >= LEAST_TERMS]
        self.ids, self.words = [ids[i] for i in use], [h[i] for i in use]
        self.vocab = np.unique(np.concatenate(self.words)) if use else np.zeros(0, np.uint64)
        held = self.split(answers) if answers is not None else [np.zeros(0, np.uint64)] * len(h)
        self.answers = [set(held[i].tolist()) for i in use]
        #: by length: items that are only searched as they are
        self.short: dict[int, dict[tuple, list[int]]] = {}
        for i in sorted(set(range(len(h))) - set(use)):
            if len(h[i]) >= LEAST_EXACT:
                self.short.setdefault(len(h[i]), {}).setdefault(tuple(h[i].tolist()), []).append(ids[i])

    @staticmethod
    def split(texts: pa.Array) -> list[np.ndarray]:
        w = words_of(texts)
        h = w.hashes()
        return [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]

    def weigh(self, df: np.ndarray, blocks: int) -> None:
        """Inverse document frequencies; stop terms weigh nothing."""
        idf = np.log((blocks + 1) / (df + 1)) + 1
        used = df <= STOP * blocks
        for x in self.words:
            at = np.unique(np.searchsorted(self.vocab, x))
            if used[at].sum() < LEAST_TERMS:
                used[at] = True
        self.idf = np.where(used, idf, 0.0)
        self.telling = []
        for x, answer in zip(self.words, self.answers):
            at = np.unique(np.searchsorted(self.vocab, x))
            self.telling.append(answer or set(self.vocab[at[np.argsort(-idf[at], kind="stable")[:TELLING]]].tolist()))
        self.counts = [dict(zip(*(v.tolist() for v in np.unique(x, return_counts=True)))) for x in self.words]
        bits = []
        for x in self.words:
            own: dict[int, int] = {}
            for i, v in enumerate(x.tolist()):
                own[v] = own.get(v, 0) | (1 << i)
            bits.append(own)
        self.bits = bits

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, term, weight): the items' unit vectors, only what is not zero. Of equal length, so that no item falls out
        of the latent space for its few or plain words."""
        item = np.repeat(np.arange(len(self.words)), [len(x) for x in self.words])
        key, n = np.unique((item << 32) + np.searchsorted(self.vocab, np.concatenate(self.words)), return_counts=True)
        item, term = key >> 32, key & 0xFFFFFFFF
        weight = n * self.idf[term]
        length = np.sqrt(np.bincount(item, weight**2, len(self.words)))
        return item, term, weight / np.maximum(length, 1e-12)[item]

    def lists(self) -> tuple[np.ndarray, ...]:
        """For ``shared_words``: each item's distinct terms, how often it has them, and where its list begins (one more: the
        end); the same of its telling terms; how many telling words no item has; words and telling words in all."""
        term = [np.searchsorted(self.vocab, np.array(sorted(x), np.uint64)) for x in self.counts]
        often = [[x[v] for v in sorted(x)] for x in self.counts]
        known = [np.array(sorted(x), np.uint64) for x in self.telling]
        known = [x[np.isin(x, self.vocab)] for x in known]
        edges = [np.cumsum([0, *map(len, x)]) for x in (term, known)]
        size, telling = (np.array([len(x) for x in y]) for y in (self.words, self.telling))
        return np.concatenate(term), np.concatenate(often), edges[0], np.searchsorted(self.vocab, np.concatenate(known)), edges[1], telling - np.diff(edges[1]), size, telling

    def latent_of(self, projection: np.ndarray) -> np.ndarray:
        """The items' directions in a latent space."""
        own = np.stack([projection[np.searchsorted(self.vocab, x)].sum(0) for x in self.words])
        return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)


def gram(matrix: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray) -> np.ndarray:
    """A'(A right) of a sparse matrix A, given by (row, column, value) in order of rows."""
    row, column, value = matrix
    begin = runs(row)
    own = np.add.reduceat(right[column] * value[:, None], begin, axis=0)
    out = np.zeros_like(right)
    order = np.argsort(column, kind="stable")
    back = own[(np.cumsum(np.isin(np.arange(len(row)), begin)) - 1)[order]] * value[order][:, None]
    first = runs(column[order])
    out[column[order][first]] = np.add.reduceat(back, first, axis=0)
    return out


def add_runs(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run, as np.add.reduceat(values, begin, axis=0), which is slow where runs are short: the
    first rows of all runs, then the second ones of those that have one, and so on."""
    size = np.diff(np.append(begin, len(values)))
    if size.max(initial=0) > 256:
        return np.add.reduceat(values, begin, axis=0)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    total = values[begin]
    for k in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # runs of more than k rows
        total[:n] += values[begin[:n] + k]
    out = np.empty_like(total)
    out[order] = total
    return out


def shared_words(doc: np.ndarray, item: np.ndarray, at: np.ndarray, term: np.ndarray, lists: tuple[np.ndarray, ...], vocab: int, cells: int = 1 << 24) -> np.ndarray:
    """Which (document, item) pairs, in order of documents, have words enough in common for a verdict, wherever they
    stand: no fewer than any place in the document has. at, term: documents, in order, and terms of all their words in the
    vocabulary. At most ``cells`` cells (or one document's) are held at once."""
    own, often, edge, known, edge_known, strange, size, telling = lists
    out = np.zeros(len(doc), bool)

    def held(row: np.ndarray, j: np.ndarray, names: np.ndarray, edges: np.ndarray, weight: np.ndarray | None, has: np.ndarray) -> np.ndarray:
        n = edges[j + 1] - edges[j]
        first = np.concatenate([[0], np.cumsum(n)])
        flat = np.repeat(edges[j] - first[:-1], n) + np.arange(first[-1])
        hit = has[np.repeat(row, n), names[flat]]
        return sums(hit if weight is None else hit * weight[flat], first)

    step = max(1, cells // max(1, vocab))
    docs = np.unique(doc)
    for k in range(0, len(docs), step):
        some = docs[k : k + step]
        has = np.zeros((len(some), vocab), bool)
        a, e = np.searchsorted(at, [some[0], some[-1] + 1])
        row = np.minimum(np.searchsorted(some, at[a:e]), len(some) - 1)
        right = some[row] == at[a:e]
        has[row[right], term[a:e][right]] = True
        a, e = np.searchsorted(doc, [some[0], some[-1] + 1])
        for i in range(a, e, 8192):
            pairs = slice(i, min(e, i + 8192))
            row, j = np.searchsorted(some, doc[pairs]), item[pairs]
            out[pairs] = held(row, j, own, edge, often, has) >= LEAK * size[j]
            out[pairs] |= held(row, j, known, edge_known, None, has) + strange[j] >= KEYS * telling[j]
    return out


def tokens(h: np.ndarray, vocab: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word index, term) of the words, given by their hashes, in the vocabulary (in its used part)."""
    if not len(vocab) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a table over 16 bits of the hash first: most words are in no item
    maybe = np.zeros(1 << 16, bool)
    maybe[(vocab if used is None else vocab[used]) >> np.uint64(48)] = True
    at = np.flatnonzero(maybe[h >> np.uint64(48)])
    term = np.minimum(np.searchsorted(vocab, h[at]), len(vocab) - 1)
    hit = vocab[term] == h[at]
    if used is not None:
        hit &= used[term]
    return at[hit], term[hit]


def frequencies(rows: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many blocks of eight words each term is, and the number of blocks, over all texts."""
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, blocks = np.zeros(len(shared.value), np.int64), 0
        for b in slices(batches):
            w = words_of(b.column("text"))
            blocks += int((-(-w.count // BLOCK)).sum())
            at, term = tokens(w.hashes(), shared.value)
            block = w.doc[at].astype(np.int64) * (1 << 24) + (at - w.first[w.doc[at]]) // BLOCK
            order = np.lexsort((block, term))
            new = np.ones(len(order), bool)
            new[1:] = (term[order][1:] != term[order][:-1]) | (block[order][1:] != block[order][:-1])
            df += np.bincount(term[order][new], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], blocks))], ["term", "n"])

    got = rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(vocab), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def latent(rows: DataFrame, items: Items, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Projection of weighted terms (vocabulary x rank): idf times the leading right singular vectors."""
    size = len(items.vocab)
    rank = min(rank, size, len(items.words) + 32)
    omega = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, rank)))[0].astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((items.vocab, items.idf.astype(np.float32), omega))
    chunk = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, idf, om = shared.value
        z, energy = np.zeros((len(vocab), rank), np.float64), 0.0
        for b in slices(batches):
            w = words_of(b.column("text"))
            at, term = tokens(w.hashes(), vocab, idf > 0)
            if not len(at):
                continue
            passage = w.doc[at].astype(np.int64) * (1 << 24) + (at - w.first[w.doc[at]]) // (BLOCK * SCALES[-1])
            begin = runs(passage)
            row = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
            projected = add_runs((om * idf[:, None])[term] if len(term) > len(idf) else om[term] * idf[term][:, None], begin)
            order = np.argsort(term, kind="stable")
            first = runs(term[order])
            z[term[order][first]] += add_runs(projected[row[order]], first) * idf[term[order][first]][:, None]
            energy += float((idf[term] ** 2).sum())
        for k in range(0, len(vocab), chunk):
            yield pa.RecordBatch.from_arrays([pa.array([k // chunk], pa.int32()), pa.array([z[k : k + chunk].astype(np.float32).tobytes()], pa.binary()), pa.array([energy if k == 0 else 0.0])], ["chunk", "z", "energy"])

    def total(table: pa.Table) -> pa.Table:
        z = np.sum([np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table["z"]], axis=0)
        return pa.table({"chunk": table["chunk"][:1], "z": pa.array([z.tobytes()], pa.binary()), "energy": [sum(table["energy"].to_pylist())]})

    kind = "chunk int, z binary, energy double"
    got = rows.select("text").mapInArrow(run, kind).groupBy("chunk").applyInArrow(total, kind).toArrow().sort_by("chunk")
    own = items.matrix()
    if got.num_rows:
        z = np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in got["z"]]).reshape(size, rank)
        weight = sum(got["energy"].to_pylist()) / max(float((own[2] ** 2).sum()), 1e-12)
    else:
        z, weight = np.zeros((size, rank)), 1.0
    om = omega.astype(np.float64)
    z = z + max(weight, 1e-6) * gram(own, om)
    core = om.T @ z  # Nystroem: A'A is about z core^-1 z'
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-9
    half = z @ (vector[:, good] / np.sqrt(value[good]))
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return (items.idf[:, None] * left).astype(np.float32)


def search(rows: DataFrame, items: Items, projection: np.ndarray) -> DataFrame:
    """Verified matches of all windows of all documents with all items."""
    own = items.latent_of(projection)
    shared = rows.sparkSession.sparkContext.broadcast((items.vocab, items.idf > 0, projection, own.astype(np.float32), items.ids, items.words, items.bits, items.telling, items.counts, items.lists()))

    def verify(words: list, start: int, end: int, item: int, value: tuple) -> tuple[float, float, bool] | None:
        size, bits, telling = len(value[5][item]), value[6][item], value[7][item]
        lo, hi = max(0, start - size), min(len(words), end + size)
        span, step = size + size // 4 + 1, max(1, size // 4)
        best, where = 0, lo
        for a in range(lo, max(lo + 1, hi - size + step), step):
            n = lcs(bits, size, words[a : a + span])
            if n > best:
                best, where = n, a
        near = set(words[max(0, where - step) : where + span + step])
        ratio, answer = best / size, len(telling & near) / len(telling)
        if ratio >= LEAK:
            return ratio, answer, False
        return (ratio, answer, True) if ratio >= LOOSE and answer >= KEYS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        vocab, used, proj, targets, ids, lists = *value[:5], value[9]
        for b in slices(batches):
            w = words_of(b.column("text"))
            h = w.hashes()
            every, every_term = tokens(h, vocab)
            at, term = every[used[every_term]], every_term[used[every_term]]
            if not len(at):
                continue
            total = np.zeros((len(at) + 1, proj.shape[1]), np.float32)
            np.cumsum(proj[term], axis=0, out=total[1:])
            row, inside = w.doc[at], at - w.first[w.doc[at]]
            place = np.unique((row << 32) + inside // BLOCK)
            place = np.unique(np.concatenate([place - k for k in range(SCALES[-1])]))
            place = place[(place & 0xFFFFFFFF) < 1 << 31]  # not before the text's begin
            owner, begin = place >> 32, w.first[place >> 32] + (place & 0xFFFFFFFF) * BLOCK
            owner, begin, end = np.tile(owner, len(SCALES)), np.tile(begin, len(SCALES)), np.concatenate([np.minimum(begin + scale * BLOCK, w.first[owner + 1]) for scale in SCALES])
            lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
            some = np.flatnonzero(hi > lo)
            owner, begin, end, lo, hi = owner[some], begin[some], end[some], lo[some], hi[some]
            # windows with the same weighted words have one direction: it is held against the items once
            name = np.where(hi - lo == 1, -1 - term[lo], lo * (SCALES[-1] * BLOCK + 1) + hi - lo)
            order = np.argsort(name, kind="stable")
            edges = np.append(runs(name[order]), len(order))
            one = order[edges[:-1]]
            near: list[tuple[np.ndarray, ...]] = []
            for k in range(0, len(one), 4096):
                v = total[hi[one[k : k + 4096]]] - total[lo[one[k : k + 4096]]]
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                cosine = (v @ targets.T).ravel()
                hit = np.flatnonzero(cosine >= COSINE)
                near.append((hit // len(targets) + k, hit % len(targets), cosine[hit]))
            which, item, cosine = (np.concatenate(x) for x in zip(*near))
            many = np.diff(edges)[which]
            first = np.concatenate([[0], np.cumsum(many)])
            window = order[np.repeat(edges[which] - first[:-1], many) + np.arange(first[-1])]
            item, cosine = np.repeat(item, many), np.repeat(cosine, many)
            pair = owner[window] * len(targets) + item
            pairs, where = np.unique(pair, return_inverse=True)
            keep = shared_words(pairs // len(targets), pairs % len(targets), w.doc[every], every_term, lists, len(vocab))[where]
            found: dict[tuple[int, int], list[tuple[int, int, float]]] = defaultdict(list)
            window = window[keep]
            base = w.first[owner[window]]
            for d, j, start, stop, x in zip(owner[window].tolist(), item[keep].tolist(), (begin[window] - base).tolist(), (end[window] - base).tolist(), cosine[keep].tolist()):
                found[d, j].append((start, stop, x))
            out, text, last = [], [], -1
            for (d, j), windows in sorted(found.items()):
                if d != last:
                    text, last = h[w.first[d] : w.first[d + 1]].tolist(), d
                windows.sort()
                best: tuple | None = None
                k = 0
                while k < len(windows):  # windows that meet are one place
                    start, end, cosine = windows[k]
                    while k + 1 < len(windows) and windows[k + 1][0] <= end:
                        k += 1
                        end, cosine = max(end, windows[k][1]), max(cosine, windows[k][2])
                    k += 1
                    size, counts, telling = len(value[5][j]), value[8][j], value[7][j]
                    around = set(text[max(0, start - size) : end + size])
                    if sum(map(counts.__getitem__, counts.keys() & around)) < LEAK * size and len(telling & around) < KEYS * len(telling):
                        continue  # too few words in common for either verdict
                    got = verify(text, start, end, j, value)
                    if got and (best is None or got[0] > best[1]):
                        best = (cosine, *got)
                if best:
                    out.append((b.column("doc_id")[d].as_py(), ids[j], *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))], [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def exact(rows: DataFrame, short: dict[int, dict[tuple, list[int]]]) -> DataFrame:
    """Where the words of items too short for the latent space stand together."""
    shared = rows.sparkSession.sparkContext.broadcast(short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {n: np.array(sorted({x[0] for x in own}), np.uint64) for n, own in shared.value.items()}
        for b in slices(batches):
            w = words_of(b.column("text"))
            h = w.hashes()
            found: set[tuple[int, int]] = set()
            for n, own in shared.value.items():
                at = np.flatnonzero(np.isin(h[: max(0, len(h) - n + 1)], begins[n]))
                for i in at[w.doc[at] == w.doc[at + n - 1]].tolist():
                    found |= {(int(w.doc[i]), item) for item in own.get(tuple(h[i : i + n].tolist()), ())}
            if found:
                out = [(b.column("doc_id")[d].as_py(), item, None, 1.0, 1.0, False) for d, item in sorted(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()))], [x.split()[0] for x in FOUND.split(", ")])

    return rows.mapInArrow(run, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, paraphrase): every document and benchmark item that it holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    answer = F.lit(None).cast("string") if answer_col is None else F.col(answer_col).cast("string")
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"), answer.alias("answer")).where("item_id is not null and text is not null")
    size, found = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0, []
    blocks = -(-size // BLOCK_BYTES)
    for k in range(blocks):  # about BLOCK_BYTES of items are collected at a time
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        items = Items(part["item_id"].to_pylist(), part["text"], part["answer"])
        if items.short:
            found.append(exact(rows, items.short))
        if items.ids:
            df, count = frequencies(rows, items.vocab)
            items.weigh(df, count)
            found.append(search(rows, items, latent(rows, items, rank)))
    if not found:
        return rows.sparkSession.createDataFrame([], FOUND)
    out = reduce(DataFrame.unionByName, found)
    best = F.max_by(F.struct("cosine", "answer", "paraphrase"), F.struct("lcs", "cosine", "answer"))
    out = out.groupBy("doc_id", "item_id").agg(best.alias("b"), F.max("lcs").alias("lcs"))
    return stage(out.select("doc_id", "item_id", "b.cosine", "lcs", "b.answer", "b.paraphrase"), "leaks")
