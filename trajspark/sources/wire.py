"""The fields of many protobuf messages at once, as numpy arrays over one buffer.

Messages are stretches of a byte buffer. All of them are read in step: in each round every message that has bytes left gives its next field, so Python runs once a field of the longest
message, not once a byte or a message. Where only a few long messages are left, each goes on by itself, once a field.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FEW = 12
_SIZE = np.array([0, 8, 0, -1, -1, 4, -1, -1])  # bytes of a value by kind, beside its number or length; -1: no such kind
_HAS = np.array([True, False, True, False, False, False, False, False])  # kinds with a number or length


@dataclass
class Fields:
    """Fields in the order of their messages, and within these as they stand: whose they are, number, kind (wire type), value of integers, and where the bytes of others are."""

    owner: np.ndarray
    number: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    start: np.ndarray
    end: np.ndarray
    broken: np.ndarray  # for each message: whether it can't be read to its end

    def where(self, keep: np.ndarray) -> "Fields":
        return Fields(*[x[keep] for x in (self.owner, self.number, self.kind, self.value, self.start, self.end)], self.broken)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary or string column, and where each value starts and ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    valid, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = at[:-1], at[1:].copy()
    if column.null_count:
        empty = column.is_null().to_numpy(zero_copy_only=False)
        end[empty] = start[empty]
    return data, start, end


def varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers that start at some places, where they end, and which are whole: ten bytes at most, and none beyond `end`."""
    value, stop, whole = np.zeros(len(at), np.uint64), at.copy(), np.zeros(len(at), bool)
    if len(at) and (at < end).all():  # most are of one byte
        byte = data[at]
        value[:], stop = byte & 127, at + 1
        whole = byte < 128
        open_ = np.flatnonzero(~whole)
        open_, begin = open_[stop[open_] < end[open_]], 7
    else:
        open_, begin = np.flatnonzero(at < end), 0
    for shift in range(begin, 70, 7):
        if not len(open_):
            break
        byte = data[stop[open_]]
        value[open_] |= (byte & 127).astype(np.uint64) << np.uint64(shift)
        stop[open_] += 1
        last = byte < 128
        whole[open_[last]] = True
        open_ = open_[~last]
        open_ = open_[stop[open_] < end[open_]]
    return value, stop, whole


def _single(data: memoryview, at: int, end: int) -> tuple[list[tuple], bool]:
    """The fields of one message, in plain Python: (number, kind, value, start, end), and whether it broke off."""
    out = []

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while at < end and shift < 70:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value & 0xFFFFFFFFFFFFFFFF, at
        return -1, at

    while at < end:
        tag, at = varint(at)
        kind = tag & 7
        if tag < 0 or kind not in (0, 1, 2, 5):
            return out, True
        size = 8 if kind == 1 else 4
        if kind in (0, 2):
            size, at = varint(at)
            if size < 0:
                return out, True
        if kind == 0:
            out.append((tag >> 3, 0, size, at, at))
            continue
        if at + size > end:
            return out, True
        out.append((tag >> 3, kind, 0, at, at + size))
        at += size
    return out, False


def fields(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Fields:
    """All fields of the messages at data[start:end]."""
    at, broken, parts = start.astype(np.int64).copy(), np.zeros(len(start), bool), []
    end = end.astype(np.int64)
    active = np.flatnonzero(at < end)
    while len(active) > FEW:
        tag, next_, ok = varints(data, at[active], end[active])
        kind = (tag & np.uint64(7)).astype(np.int64)
        number, more, whole = varints(data, next_, end[active])  # a value or a length, where the kind has one
        has = _HAS[kind]
        ok &= (_SIZE[kind] >= 0) & (~has | whole)
        begin = np.where(has, more, next_)
        size = np.where(kind == 2, np.minimum(number, np.uint64(1 << 62)).astype(np.int64), _SIZE[kind])
        stop = begin + size
        ok &= stop <= end[active]
        if not ok.all():
            broken[active[~ok]] = True
            active, tag, kind, number, begin, stop = (x[ok] for x in (active, tag, kind, number, begin, stop))
        number[kind != 0] = 0
        parts.append((active, (tag >> np.uint64(3)).astype(np.int64), kind, number, begin, stop))
        at[active] = stop
        active = active[stop < end[active]]
    view = memoryview(np.ascontiguousarray(data))
    for i in active.tolist():
        found, bad = _single(view, int(at[i]), int(end[i]))
        broken[i] |= bad
        if found:
            number, kind, value, begin, stop = zip(*found)
            parts.append((np.full(len(found), i), np.array(number, np.int64), np.array(kind, np.int64), np.array(value, np.uint64), np.array(begin, np.int64), np.array(stop, np.int64)))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64)
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]
    order = np.argsort(columns[0], kind="stable")
    return Fields(*[c[order] for c in columns], broken)


def signed(value: np.ndarray) -> np.ndarray:
    return value.astype(np.uint64).view(np.int64)


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches, one after another, and the n + 1 offsets into them."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def binaries(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    whole, at = gathered(data, start, end)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(whole))])


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches as text; what is not UTF-8 is replaced."""
    found = binaries(data, start, end)
    try:
        return found.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # only rows with bytes over 127 can be at fault
        whole, at = gathered(data, start, end)
        high = np.concatenate([[0], np.cumsum(whole > 127)])
        odd = high[at[1:]] > high[at[:-1]]
        plain = binaries(data, start, np.where(odd, start, end)).cast(pa.large_string()).cast(pa.string())
        return pc.replace_with_mask(plain, pa.array(odd), pa.array([found[i].as_py().decode("utf-8", "replace") for i in np.flatnonzero(odd).tolist()], pa.string()))


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The integers that follow one another in each stretch, and how many each has; one that breaks off at the end is left out."""
    whole, at = gathered(data, start, end)
    stops = np.flatnonzero(whole < 128)
    owner = np.searchsorted(at, stops, "right") - 1
    first = np.empty(len(stops), np.int64)
    first[:1] = 0
    first[1:] = stops[:-1] + 1
    first = np.maximum(first, at[owner])  # what broke off before belongs to the stretch before
    value, length = np.zeros(len(stops), np.uint64), stops - first + 1
    for k in range(min(10, int(length.max(initial=0)))):
        more = length > k
        value[more] |= (whole[first[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return value, np.bincount(owner, minlength=len(start))


_CHUNK = 256


def _byte_table() -> np.ndarray:
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = n >> np.uint32(1) ^ np.where(n & 1, np.uint32(0x82F63B78), np.uint32(0))
    return n


TABLE = _byte_table()


def _advanced() -> list[list[int]]:
    """What _CHUNK zero bytes make of a state, for each value of each of its four bytes (the map is linear)."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_CHUNK):
        state = state >> np.uint32(8) ^ TABLE[state & 255]
    out = []
    for byte in range(4):
        table = np.zeros(256, np.uint32)
        for bit in range(8):
            table ^= np.where(np.arange(256) >> bit & 1, state[8 * byte + bit], np.uint32(0)).astype(np.uint32)
        out.append(table.tolist())
    return out


_ADVANCED = _advanced()


def crc32c(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32C of each stretch. Chunks of all stretches are worked out in step, and then joined: a state moves over a chunk by four lookups."""
    size = end - start
    chunks = -(-size // _CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])
    owner = np.repeat(np.arange(len(size)), chunks)
    k = np.arange(first[-1]) - first[owner]
    head = size[owner] - (chunks[owner] - 1) * _CHUNK  # the first chunk is the short one
    begin = start[owner] + np.where(k > 0, head + (k - 1) * _CHUNK, 0)
    length = np.where(k > 0, _CHUNK, head)
    state = np.where(k > 0, np.uint32(0), np.uint32(0xFFFFFFFF)).astype(np.uint32)
    every = np.flatnonzero(length == _CHUNK)
    some = np.flatnonzero(length < _CHUNK)
    for rows, steps in ((every, _CHUNK if len(every) else 0), (some, int(length[some].max(initial=0)))):
        for i in range(steps):
            if rows is some:
                rows = some = some[length[some] > i]
            state[rows] = state[rows] >> np.uint32(8) ^ TABLE[(state[rows] ^ data[begin[rows] + i]) & 255]
    out, states, (a, b, c, d) = [], state.tolist(), _ADVANCED
    for i in range(len(size)):
        own = states[first[i]] if chunks[i] else 0xFFFFFFFF
        for x in states[first[i] + 1 : first[i + 1]]:
            own = a[own & 255] ^ b[own >> 8 & 255] ^ c[own >> 16 & 255] ^ d[own >> 24] ^ x
        out.append(own ^ 0xFFFFFFFF)
    return np.array(out, np.uint32)
