"""Words of whole texts as numpy arrays: byte offsets and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text taken at a time; longer texts are taken whole, hashed in pieces.
CHUNK = 4 << 20


def _separators(*spans: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for a, b in spans:
        out[a : b + 1] = False
    return out


#: Bytes that belong to words: the patterns [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8.
SPACED = _separators((0x09, 0x0D), (0x20, 0x20))
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_P = numbers(1 << 12, 1)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower case if asked for
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most limit (CHUNK) bytes of text, one row at least."""
    if not batch.num_rows:
        return
    limit = limit or CHUNK
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null is empty."""
    a = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def split(texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, hashes: bool = True) -> Words:
    data, off = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = kind[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    own = off[:-1][off[:-1] < off[1:]]
    begin[own] = inside[own]  # texts lie side by side: a text's first byte may begin a word
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[own[1:] - 1] |= inside[own[1:] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(start, off)
    return Words(data, start, end, first, _hash(data, start, end) if hashes else np.zeros(0, U))


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear one over its bytes, scrambled."""
    global _P
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20), side="right")))
        s, e = start[at:to], end[at:to]
        n = e - s
        if n.max() > len(_P):
            _P = numbers(int(n.max()) * 2, 1)
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begin, n)
        values = (data[np.repeat(s, n) + inner].astype(U) + U(1)) * _P[inner]
        out[at:to] = mix(np.add.reduceat(values, begin) + n.astype(U))
        at = to
    return out


def grams(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of k consecutive words from each word on (the last k - 1 run over the end), by doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    b = U(base | 1)
    done, length, width, power = None, 0, 1, h
    while True:
        if k & width:
            if done is None:
                done, length = power, width
            else:  # power covers width words from i, done the length words after them
                n = len(h) - length - width + 1
                done = power[:n] * U(pow(int(b), length, 1 << 64)) + done[width : width + n]
                length += width
        if length == k:
            return mix(done + U(k))
        n = len(h) - 2 * width + 1
        power = power[:n] * U(pow(int(b), width, 1 << 64)) + power[width : width + n]
        width *= 2


def within(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words begin k consecutive words of one text."""
    last = np.repeat(first[1:], np.diff(first))
    return (np.arange(n) + k <= last)[: max(0, n - k + 1)]
