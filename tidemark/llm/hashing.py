"""Vectorised words and hashes over the byte buffers of Arrow string columns.

The operators look at every word of every text, so the per-word work is numpy over whole
buffers. All hashes are fixed functions of the bytes: a task that is run again after an executor is
lost gives the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (three xor-shifts, two odd multipliers)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: What a worker may keep between tasks of one kind, by name: functions that let it go.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: The six ASCII white-space bytes that end a word.
SPACE = _table(b" \t\n\x0b\x0c\r")
#: Everything but letters, digits and bytes of non-ASCII characters.
NOT_ALNUM = ~_table(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_B, _C = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(int(n), 1 << 16) + (1 << 14)  # no more than a slice needs: every worker holds them
        inverse = U(pow(int(_B), -1, 1 << 64))
        for name, base in (("up", _B), ("down", inverse)):
            steps = np.full(size, base, U)
            steps[0] = U(1)
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more: the end). A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is alone in its batch. At the end the
    worker gives freed memory back to the system, since workers live on between tasks; at the start it lets go of what
    tasks of other kinds than ``keep`` left."""
    for name, free in KEPT.items():
        if name != keep:
            free()
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            base = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end
    give_back()


class Words:
    """Words of a batch of texts. ``doc``: row of each word; ``first``: first word of each row (and the total)."""

    def __init__(self, texts: pa.Array, ends: np.ndarray = SPACE, lower: bool = False):
        raw, self.offsets = buffer_of(texts)
        self.raw = raw
        self.buf = LOWER[raw] if lower else raw
        inside = ~ends[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.offsets] = True
        before = np.ones(len(raw), bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(raw), bool)
        after[:-1] = ~inside[1:]
        self.start = np.flatnonzero(inside & (before | edge[:-1]))
        self.end = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self._sums: np.ndarray | None = None

    def hash_of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        up, down = _powers(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, U)
            np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[begin]) * down[begin] + (end - begin).astype(U) * _C)

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words (indexes) of the n-word windows inside one text, and the windows' hashes."""
        total = len(hashes)
        if total < n:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])
        h = hashes[: total - n + 1].copy()
        for k in range(1, n):
            h *= _C
            h += hashes[k : total - n + 1 + k]
        return at, mix(h[at])

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the words' flags are set, by row."""
        return sums(flags, self.first)

    def words(self) -> list[str]:
        """The words as strings."""
        data = self.raw.tobytes()
        return [data[a:b].decode() for a, b in zip(self.start.tolist(), self.end.tolist())]


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between rows even where the contents agree."""
    return mix(h ^ mix(doc.astype(U) + U(0x51ED27)))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def to_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
