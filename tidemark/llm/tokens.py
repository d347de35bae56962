"""Token ids of whole texts by the tokenizers library, without encoding a word again and again.

A byte-level tokenizer splits a text before merging, and a single space or newline between two words always begins a
new part there; so does one ASCII mark at a word's end behind a letter or digit. So the ids of a text are those of its
words, each with the separator before it, and those of such marks, and words met before come from a cache (by 64-bit
hash). Texts where that does not hold (other white space or longer runs of it, added tokens) and other kinds of
tokenizers take the library's plain path; the ids are the same either way.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .hashing import KEPT, NOT_ALNUM, U, Words, _table, mix, sums

#: White space other than space and newline that some pattern could treat as such, and bytes with which it begins.
ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0" + "".join(map(chr, (0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF))) + "]")
SUSPECT = _table(bytes([9, *range(11, 14), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]))
#: Bytes that stand before a word: nothing, a space, a newline, two newlines.
LEADS = np.array([0, 1, 1, 2])
#: Words in a worker's cache (about 50 bytes each); beyond it only those met again stay. Words encoded at a time.
CACHED, CHUNK = 1_000_000, 2000
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after another."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(end[-1] if len(end) else 0)


def _longer(a: np.ndarray, n: int) -> np.ndarray:
    """An array for n entries at least that begins with ``a``."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class Known:
    """Ids of words by the words' hashes: an open-addressing table of numbers, searched for many words at once."""

    def __init__(self) -> None:
        self.count, self.end = 0, 0  # words; ids of all of them
        self.table, self.number = np.zeros(1 << 12, U), np.zeros(1 << 12, np.int32)
        self.key, self.begin, self.size, self.met = np.zeros(1 << 11, U), np.zeros(1 << 11, np.int64), np.zeros(1 << 11, np.int32), np.zeros(1 << 11, bool)
        self.ids = np.zeros(1 << 13, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none. Keys are not 0."""
        out = np.full(len(keys), -1, np.int64)
        rest, at = np.arange(len(keys)), (keys & U(len(self.table) - 1)).astype(np.int64)
        while len(rest):
            held = self.table[at]
            same = held == keys[rest]
            out[rest[same]] = self.number[at[same]]
            on = ~same & (held != 0)
            rest, at = rest[on], (at[on] + 1) & (len(self.table) - 1)
        return out

    def _enter(self, numbers: np.ndarray) -> None:
        at = (self.key[numbers] & U(len(self.table) - 1)).astype(np.int64)
        while len(numbers):
            free = self.table[at] == 0
            self.table[at[free]] = self.key[numbers[free]]  # of several for one place the last has it
            own = free & (self.table[at] == self.key[numbers])
            self.number[at[own]] = numbers[own]
            numbers, at = numbers[~own], (at[~own] + 1) & (len(self.table) - 1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that are not there yet, with their numbers of ids and all these ids."""
        n, end = self.count + len(keys), self.end + len(ids)
        self.key, self.begin, self.size, self.met = (_longer(x, n) for x in (self.key, self.begin, self.size, self.met))
        self.ids = _longer(self.ids, end + 1)  # one more: behind a word there is always an id to read
        self.key[self.count : n], self.size[self.count : n], self.met[self.count : n] = keys, sizes, False
        self.begin[self.count : n] = self.end + np.cumsum(sizes) - sizes
        self.ids[self.end : end] = ids
        fresh, self.count, self.end = np.arange(self.count, n), n, end
        if 2 * n > len(self.table):
            size = 1 << (4 * n - 1).bit_length() - 1
            self.table, self.number, fresh = np.zeros(size, U), np.zeros(size, np.int32), np.arange(n)
        self._enter(fresh)

    def again(self, most: int) -> Known:
        """A table of the words that were found here, if these are no more than ``most``, or an empty one."""
        out, stay = Known(), np.flatnonzero(self.met[: self.count])
        if len(stay) <= most:
            out.add(self.key[stay], self.size[stay], self.ids[_spans(self.begin[stay], self.size[stay])])
        return out


class Encoder:
    def __init__(self, definition: str):
        self.tok = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        vocabulary = self.tok.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.newline = np.zeros(len(self.opens), bool)
        self.newline[[i for t, i in vocabulary.items() if t == "Ċ"]] = True
        plain = spec.get("normalizer") or spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding")
        self.fast = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not plain and self.newline.sum() == 1
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.cache = Known()
        self.mark = np.full(256, -1, np.int64)  # the id of a mark that stands alone, if it is one
        if self.fast:
            for m in MARKS:
                ids = self.tok.encode(chr(m), add_special_tokens=False).ids
                self.mark[m] = ids[0] if len(ids) == 1 else -1

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, keys: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, leads: np.ndarray) -> None:
        """Encode words, each from the separator before it. Several in one text where one id opens each word and stands nowhere else."""
        for lead in range(len(LEADS)):
            some = np.flatnonzero(leads == lead)
            size = end[some] - begin[some] + LEADS[lead]
            data, edge = raw[_spans(begin[some] - LEADS[lead], size)].tobytes(), np.append(0, np.cumsum(size)).tolist()
            for a in range(0, len(some), CHUNK):
                z = min(a + CHUNK, len(some))
                if lead in (1, 2):
                    found = self.tok.encode_batch_fast([data[edge[a] : edge[z]].decode()], add_special_tokens=False)
                    ids = np.array(found[0].ids, "<u4")
                    sizes = np.diff(np.append(np.flatnonzero((self.opens if lead == 1 else self.newline)[ids]), len(ids)))
                else:
                    found = self.tok.encode_batch_fast([data[edge[i] : edge[i + 1]].decode() for i in range(a, z)], add_special_tokens=False)
                    ids, sizes = np.array([i for e in found for i in e.ids], "<u4"), np.array([len(e) for e in found])
                self.cache.add(keys[some[a:z]], sizes, ids)

    def _regular(self, w: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have only single spaces and one or two newlines between words; the lead of every word."""
        head = np.zeros(len(w.start), bool)
        head[w.first[:-1][w.count > 0]] = True
        gap = w.start - np.concatenate([[0], w.end[:-1]])[: len(w.start)]
        before = w.raw[np.maximum(w.start - 1, 0)] if len(w.start) else w.raw[:0]
        lead = np.where(gap == 1, np.where(before == 32, 1, 2), 3)
        bad = (gap > 2) | (gap == 1) & (before != 32) & (before != 10) | (gap == 2) & ((before != 10) | (w.raw[np.maximum(w.start - 2, 0)] != 10))
        bad[head] = (w.start != w.offsets[:-1][w.doc])[head]
        lead[head] = 0
        good = w.per_doc(bad) == 0
        some = w.count > 0
        good[some] &= w.end[w.first[1:][some] - 1] == w.offsets[1:][some]
        good &= some | (np.diff(w.offsets) == 0)
        data = w.raw.tobytes()
        if any(a.encode() in data for a in self.added):
            good &= np.array([not t or not any(a in t for a in self.added) for t in texts.to_pylist()])
        for i in np.flatnonzero(good & (sums(SUSPECT[w.raw], w.offsets) > 0)).tolist():
            good[i] = not ODD.search(texts[i].as_py())
        return good, lead

    def encode(self, texts: pa.Array, cached: int = CACHED) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. A null text is empty."""
        if not self.fast:
            return [self.plain(t) if t else b"" for t in texts.to_pylist()]
        w = Words(texts)
        good, lead = self._regular(w, texts)
        used = np.flatnonzero(good[w.doc])
        start, stop, lead = w.start[used], w.end[used], lead[used]
        mark, before, lead_byte = self.mark[w.raw[stop - 1]], w.raw[np.maximum(stop - 2, 0)], w.raw[np.maximum(stop - 3, 0)]
        letter = ~NOT_ALNUM[before] & (before < 128) | (lead_byte == 0xC3) & (before >= 128) & (before != 0x97) & (before != 0xB7)  # U+00C0 to U+00FF
        marked = (mark >= 0) & (stop - start > 1) & letter
        stop = stop - marked
        key = np.maximum(mix(w.hash_of(start, stop) + lead.astype(U) * U(0x632BE59BD9B4E019)), U(1))
        if self.cache.count > cached:
            self.cache = self.cache.again(cached // 2)
        number = self.cache.find(key)
        new = np.flatnonzero(number < 0)
        self.cache.met[number[number >= 0]] = True
        if len(new):
            distinct, at = np.unique(key[new], return_index=True)
            one = new[at]
            self._learn(distinct, w.raw, start[one], stop[one], lead[one])
            number[new] = self.cache.find(key[new])
        count = np.zeros(len(w.start), np.int64)
        count[used] = self.cache.size[number] + marked
        end = np.cumsum(count)
        ids = self.cache.ids[_spans(self.cache.begin[number], count[used])]
        ids[end[used[marked]] - 1] = mark[marked]
        edges = (np.concatenate([[0], end])[w.first] * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] if g else self.plain(t.as_py()) for g, a, b, t in zip(good.tolist(), edges[:-1], edges[1:], texts)]


_encoders: dict[int, Encoder] = {}
KEPT["tokens"] = _encoders.clear


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer's JSON; kept between tasks."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
