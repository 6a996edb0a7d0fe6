"""Words of whole texts as numpy arrays, straight from Arrow's buffers.

A word is a longest run of bytes other than space and 0x09-0x0D. UTF-8 never has these inside a
character, so bytes do for all languages. A word's hash is a chain of bijective mixing steps over its 8-byte
blocks (a cryptographic hash from LONG bytes on), so no pattern in the letters makes words meet: two different ones
get the same 64 bits with a probability of 2**-64 a pair. Runs of up to some hundred words are told apart as well.

Separators and hashes are worked out a stretch at a time, so beyond its bytes a text costs some 4 bytes for each of them,
however long it is.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG = 256

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STRETCH = 1 << 20  # bytes of text worked on at once
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eight_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number, first byte lowest; beyond the end there are zeros."""
    if len(data) < 8:
        data = np.concatenate([data, np.zeros(8 - len(data), np.uint8)])
    data = np.ascontiguousarray(data)
    last = len(data) - 8
    inner = np.minimum(at, last)
    return np.ndarray((last + 1,), np.uint64, data.data, 0, (1,))[inner] >> ((at - inner).astype(np.uint64) << np.uint64(3))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each stretch of bytes."""
    left = ends - starts
    out = left.astype(np.uint64) * _ODD
    long_ = np.flatnonzero(left > LONG)
    out = mix(out ^ (eight_bytes(data, starts) & _MASKS[np.minimum(left, 8)]))
    more = np.flatnonzero((left > 8) & (left <= LONG))
    at, left = starts[more] + 8, left[more] - 8
    while len(more):
        out[more] = mix(out[more] * _ODD ^ (eight_bytes(data, at) & _MASKS[np.minimum(left, 8)]))
        on = left > 8
        more, at, left = more[on], at[on] + 8, left[on] - 8
    for i in long_.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        _, at = texts(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Hand freed memory back at a task's end: workers live on, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not glibc


class Words:
    """The words of a string column: word i is data[starts[i]:ends[i]]; document d has words first[d] to first[d + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = texts(column)
        if lower:
            self.data = LOWER[self.data]
        data, n, starts, ends = self.data, len(self.data), [], []
        for a in range(0, n, _STRETCH):
            word = np.empty(min(_STRETCH, n - a) + 1, bool)
            word[0] = a > 0 and not separator[data[a - 1]]
            np.logical_not(separator[data[a : a + _STRETCH]], out=word[1:])
            turns = np.flatnonzero(word[1:] != word[:-1])
            begins = word[turns + 1]
            starts.append(turns[begins] + a)
            ends.append(turns[~begins] + a)
        if n and not separator[data[-1]]:
            ends.append(np.array([n]))
        inner = np.unique(self.offsets[1:-1])
        inner = inner[(inner > 0) & (inner < n)]
        inner = inner[~(separator[data[inner - 1]] | separator[data[inner]])]  # no word reaches over the end of its text
        self.starts, self.ends = (np.concatenate([*x, inner]).astype(np.int64) for x in (starts, ends))
        if len(inner):
            self.starts.sort()
            self.ends.sort()
        self._count()

    def _count(self) -> None:
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """One hash for each word."""
        out = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(out), _STRETCH // 8):
            own = slice(i, i + _STRETCH // 8)
            out[own] = stretch_hashes(self.data, self.starts[own], self.ends[own])
        return out

    def runs(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The hash of k words from each word on, and how many of them each document has, which lead its stretch of `first`.

        Entry i stands for words i to i + k - 1; entries that reach over a document's end mean nothing.
        """
        h = self.hashes() if hashes is None else hashes
        return combine(h, k), np.maximum(self.counts - k + 1, 0)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k neighbours: a polynomial in their (mixed) hashes, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    part, length, done, total, shift = h, 1, 0, None, 1
    up = [pow(0xD6E8FEB86659FD93, 2**i, 1 << 64) for i in range(k.bit_length())]
    n, bit = len(h) - k + 1, 0
    while k >> bit:
        if k >> bit & 1:
            term = part[done : done + n] * np.uint64(shift)
            total = term if total is None else total + term
            done += length
            shift = shift * up[bit] % (1 << 64)
        if k >> (bit + 1):
            part = part[: len(part) - length] + part[length:] * np.uint64(up[bit])
            length *= 2
        bit += 1
    return mix(total + np.uint64(k))


def joined(w: Words, keep: np.ndarray | None = None) -> list[bytes]:
    """The kept words of each document with one space between them."""
    starts, stops, first = w.starts, w.ends + 1, w.first
    if keep is not None:
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        starts, stops = starts[keep], stops[keep]
    stops[first[1:][first[1:] > first[:-1]] - 1] -= 1  # a document's last kept word has no space after it
    edge = np.zeros(len(w.data) + 2, np.int8)
    edge[starts] = 1
    edge[stops] -= 1
    taken = w.data[np.cumsum(edge[: len(w.data)], dtype=np.int8).view(bool)]
    taken[SEPARATOR[taken]] = 32
    cut = np.concatenate([[0], np.cumsum(stops - starts)])[first]
    whole = taken.tobytes()
    return [whole[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
