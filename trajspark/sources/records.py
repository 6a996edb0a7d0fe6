"""A data source for gzip-compressed record shards of protobuf feature maps, and the accessibility forests in them.

A record is framed as its length (8 bytes, little-endian), a checksum (4), the data, and another checksum (4). gzip
cannot be split, so a shard is a partition. Paths go through pyarrow's file systems (local, S3, HDFS, ...; a path with a scheme, or a local one), and may hold
wildcards in their last part. Checksums are skipped unless the option `verify` is true; a wrong one and a record cut short are
errors. The reader streams: a task holds one Arrow batch of BATCH records, or of BATCH_BYTES if that is less, at a time; it checks and decodes it as a whole (see `wire`).

The writer takes the column `features`. Each task writes a shard to a folder of the job's own; the driver moves shards to their names when all have ended, and deletes that folder whether they
ended or failed. So a failed or repeated task leaves nothing, and readers see whole shards only.
"""

from __future__ import annotations

import fnmatch
import gzip
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import schemas
from . import wire

BATCH, BATCH_BYTES = 1024, 4 << 20
LEVEL = 1  # of gzip, whose default of 9 is the slowest
SHORT = 16_384  # bytes up to which a checksum is worked out byte by byte, which is faster there
SCHEMA = "features MAP<STRING, STRUCT<bytes_list:ARRAY<BINARY>, float_list:ARRAY<FLOAT>, int64_list:ARRAY<BIGINT>>>, shard STRING, position BIGINT"


_TABLE = wire.TABLE.tolist()


def checksum(data: bytes) -> int:
    """The masked CRC-32C of a frame's length or data."""
    if len(data) < SHORT:
        crc = 0xFFFFFFFF
        for byte in data:
            crc = crc >> 8 ^ _TABLE[(crc ^ byte) & 255]
        crc ^= 0xFFFFFFFF
    else:
        crc = int(wire.crc32c(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([len(data)]))[0])
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def checksums(parts: list[bytes]) -> np.ndarray:
    """`checksum` of each, worked out in step."""
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    crc = wire.crc32c(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], end[:-1]]).astype(np.int64), end)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def _held(stream, name: str) -> Iterator[list[tuple[bytes, bytes]]]:
    """Frames (head and body) as they stand, a batch at a time."""
    held, size = [], 0
    while head := stream.read(12):
        if len(head) < 12:
            raise OSError(f"truncated header in {name}")
        n = struct.unpack_from("<Q", head)[0]
        body = stream.read(n + 4)
        if len(body) < n + 4:
            raise OSError(f"truncated data in {name}")
        held.append((head, body))
        size += n
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _checked(held: list[tuple[bytes, bytes]], name: str) -> None:
    for what, parts in (("a header", [(h[:8], h[8:]) for h, _ in held]), ("data", [(b[:-4], b[-4:]) for _, b in held])):
        said = np.frombuffer(b"".join(c for _, c in parts), "<u4")
        if (said != checksums([p for p, _ in parts])).any():
            raise OSError(f"wrong checksum of {what} in {name}")


def framed(records: list[bytes]) -> bytes:
    """Records as they stand in a shard, one after another; see `frame`."""
    sizes = [struct.pack("<Q", len(r)) for r in records]
    heads, bodies = checksums(sizes).astype("<u4"), checksums(records).astype("<u4")
    return b"".join(x for z, h, r, b in zip(sizes, heads, records, bodies) for x in (z, h.tobytes(), r, b.tobytes()))


def frames(stream, name: str = "shard", verify: bool = False) -> Iterator[bytes]:
    """The data of each frame."""
    while head := stream.read(12):
        if len(head) < 12:
            raise OSError(f"truncated header in {name}")
        size = struct.unpack_from("<Q", head)[0]
        if verify and struct.unpack_from("<I", head, 8)[0] != checksum(head[:8]):
            raise OSError(f"wrong checksum of a header in {name}")
        body = stream.read(size + 4)
        if len(body) < size + 4:
            raise OSError(f"truncated data in {name}")
        if verify and struct.unpack_from("<I", body, size)[0] != checksum(body[:size]):
            raise OSError(f"wrong checksum of data in {name}")
        yield body[:size]


def frame(data: bytes) -> bytes:
    """A record as it stands in a shard (for tests and exports)."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", checksum(size)) + data + struct.pack("<I", checksum(data))


# Field numbers of the public accessibility messages (windows, tree, nodes; a node's fields; a rectangle's sides).
WINDOWS, TREE, NODES = 1, 11, 1
NODE = {1: "unique_id", 2: "bounds", 3: "class_name", 4: "content_description", 7: "text", 10: "view_id_resource_name", 14: "is_clickable", 15: "is_editable", 19: "is_long_clickable", 23: "is_visible_to_user", 27: "depth"}
SIDES = {1: "left", 2: "top", 3: "right", 4: "bottom"}


_LISTS = pa.struct([("bytes_list", pa.list_(pa.binary())), ("float_list", pa.list_(pa.float32())), ("int64_list", pa.list_(pa.int64()))])


class Level:
    """Messages of one depth in all rows: their fields, and the row that each message belongs to. `broken` says which rows can't be read."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, broken: np.ndarray):
        self.data, self.row, self.broken = data, row, broken
        self.fields = wire.fields(data, start, end)
        broken[row[self.fields.broken]] = True

        self._sorted = None

    def of(self, number: int) -> wire.Fields:
        """The fields of a number."""
        if self._sorted is None:
            order = np.argsort(self.fields.number, kind="stable")
            self._sorted = self.fields.where(order)
        a, z = np.searchsorted(self._sorted.number, [number, number + 1])
        return self._sorted.where(slice(a, z))

    def below(self, number: int | None = None) -> "Level":
        """The messages in fields of a number (None: in all fields); integers there break their row."""
        f = self.fields if number is None else self.of(number)
        row, whole = self.row[f.owner], f.kind != 0
        self.broken[row[~whole]] = True
        return Level(self.data, np.where(whole, f.start, 0), np.where(whole, f.end, 0), row, self.broken)

    def last(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each message where the bytes of its last field of a number are, its integer value, and its kind (-1: it has none)."""
        f, n = self.of(number), len(self.row)
        start, end, value, kind = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64), np.full(n, -1)
        start[f.owner], end[f.owner], value[f.owner], kind[f.owner] = f.start, f.end, f.value, f.kind
        return start, end, value, kind


def _listed(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values in the order of their owners, as a list for each of `rows`."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), values)


def examples(column: pa.Array) -> tuple[pa.MapArray, np.ndarray]:
    """The feature maps of a column of records, and which records can't be read (their maps are empty). A record's messages hold entries (1: key, 2: feature), a feature one list (1: bytes, 2: floats, 3: integers).

    Of entries with one key the last counts.
    """
    data, start, end = wire.buffer(column)
    broken = np.zeros(len(start), bool)
    entries = Level(data, start, end, np.arange(len(start)), broken).below().below()
    key, feature = entries.last(1), entries.last(2)
    broken[entries.row[(key[3] <= 0) | (feature[3] == 0)]] = True
    lists = Level(data, feature[0], feature[1], entries.row, broken)
    number, of = lists.fields.number, lists.fields.owner
    inner = lists.below()
    f, number, of = inner.fields, number[inner.fields.owner], of[inner.fields.owner]
    n = len(entries.row)

    some = number == 1
    broken[entries.row[of[some & (f.kind == 0)]]] = True
    some &= f.kind != 0
    as_bytes = _listed(of[some], n, wire.binaries(data, f.start[some], f.end[some]).cast(pa.binary()))
    some = number == 2
    broken[entries.row[of[some & ((f.kind == 0) | ((f.end - f.start) % 4 != 0))]]] = True
    some &= (f.kind != 0) & ((f.end - f.start) % 4 == 0)
    raw, at = wire.gathered(data, f.start[some], f.end[some])
    floats = _listed(np.repeat(of[some], np.diff(at) // 4), n, pa.array(np.ascontiguousarray(raw).view("<f4"), pa.float32()))
    some = (number != 1) & (number != 2)
    broken[entries.row[of[some & ((f.kind == 1) | (f.kind == 5))]]] = True
    many, one = some & (f.kind == 2), some & (f.kind == 0)
    value, count = wire.packed(data, f.start[many], f.end[many])
    place = np.concatenate([np.repeat(np.flatnonzero(many), count), np.flatnonzero(one)])  # packed and single integers, as they stand
    order = np.argsort(place, kind="stable")
    integers = _listed(of[place[order]], n, pa.array(wire.signed(np.concatenate([value, f.value[one]]))[order], pa.int64()))

    keys = wire.strings(data, key[0], key[1])
    keep = ~broken[entries.row]
    if len(keys):
        row_key = pa.table({"row": entries.row, "key": keys, "at": np.arange(n)}).group_by(["row", "key"]).aggregate([("at", "max")])
        latest = np.zeros(n, bool)
        latest[row_key.column("at_max").to_numpy()] = True
        keep &= latest
    kept = pa.array(np.flatnonzero(keep))
    items = pa.StructArray.from_arrays([x.take(kept) for x in (as_bytes, floats, integers)], fields=list(_LISTS))
    return pa.MapArray.from_arrays(pa.array(np.searchsorted(entries.row[keep], np.arange(len(start) + 1)), pa.int32()), keys.take(kept), items), broken


_SIDES = [pa.field(s, pa.int32()) for s in ("left", "top", "right", "bottom")]


def _whole_numbers(value: np.ndarray, row: np.ndarray, broken: np.ndarray) -> pa.Array:
    """Integers of 32 bits; others break their row."""
    v = wire.signed(value)
    wide = (v < -(1 << 31)) | (v >= 1 << 31)
    broken[row[wide]] = True
    return pa.array(np.where(wide, 0, v), pa.int32())


def forest_nodes(forests: pa.Array) -> pa.ListArray:
    """The nodes of all windows of each forest (null: none), in order; what a message leaves out has its default. A forest that can't be read, or has a field of another type, has no nodes."""
    data, start, end = wire.buffer(forests)
    broken = np.zeros(len(start), bool)
    found = Level(data, start, end, np.arange(len(start)), broken).below(WINDOWS).below(TREE).below(NODES)
    row, columns = found.row, {}
    for number, name in NODE.items():
        begin, stop, value, kind = found.last(number)
        if name == "bounds":
            bounds = found.below(number)
            owner = found.of(number).owner
            sides = {s: np.zeros(len(row), np.uint64) for s in SIDES.values()}
            for side, s in SIDES.items():
                f = bounds.of(side)
                broken[bounds.row[f.owner[f.kind != 0]]] = True
                sides[s][owner[f.owner]] = f.value  # later ones replace earlier ones
            columns[name] = pa.StructArray.from_arrays([_whole_numbers(sides[f.name], row, broken) for f in _SIDES], fields=_SIDES)
        elif name in ("unique_id", "depth"):
            broken[row[kind > 0]] = True
            columns[name] = _whole_numbers(value, row, broken)
        elif name.startswith("is_"):
            broken[row[kind > 0]] = True
            columns[name] = pa.array(value != 0)
        else:
            broken[row[kind == 0]] = True
            columns[name] = wire.strings(data, begin, stop)
    keep = ~broken[row]
    names = [*("unique_id", "bounds", "text", "content_description", "view_id_resource_name", "class_name", "is_clickable", "is_long_clickable", "is_editable", "is_visible_to_user", "depth")]
    every = pa.StructArray.from_arrays([columns[n] for n in names], names=names)
    return _listed(row[keep], len(start), every.filter(pa.array(keep)))


def decoded_forests(forests: Column) -> Column:
    """An array of forests as an array of arrays of raw nodes, an Arrow batch at a time; an undecodable forest has none."""

    @F.arrow_udf(f"array<array<struct<{schemas.RAW_NODE}>>>")
    def decode(lists: pa.Array) -> pa.Array:
        flat = forest_nodes(lists.flatten())
        size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)

    return decode(forests)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "RecordReader":
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> "RecordWriter":
        return RecordWriter(self.options["path"], overwrite)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.verify = options["path"], str(options.get("verify", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        head, _, tail = self.path.rpartition("/")
        if not any(c in tail for c in "*?["):
            where, path = _located(self.path)
            if where.get_file_info(path).type == fs.FileType.File:
                return [InputPartition(self.path)]
            head, tail = self.path, "*"
        where, path = _located(head)
        found = [f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and fnmatch.fnmatch(f.base_name, tail)]
        return [InputPartition(f"{head}/{f.base_name}") for f in sorted(found, key=lambda f: f.base_name)]

    def read(self, partition: InputPartition):
        where, path = _located(partition.value)
        first = 0
        with where.open_input_stream(path, compression=None) as raw, gzip.open(raw, "rb") as stream:
            for held in _held(stream, partition.value):
                if self.verify:
                    _checked(held, partition.value)
                yield _batch([body[:-4] for _, body in held], partition.value, first)
                first += len(held)


def _batch(records: list[bytes], shard: str, first: int) -> pa.RecordBatch:
    found, broken = examples(pa.array(records, pa.large_binary()))
    if broken.any():
        raise OSError(f"record {first + int(broken.argmax())} of {shard} can't be decoded")
    return pa.RecordBatch.from_arrays([found, pa.array([shard] * len(records)), pa.array(np.arange(first, first + len(records)))], names=["features", "shard", "position"])


def _number(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _field(n: int, data: bytes) -> bytes:
    return _number(n << 3 | 2) + _number(len(data)) + data


def encoded(features: list[tuple[str, dict]]) -> bytes:
    """A record's feature maps as a message; of a feature's lists the first that has values counts."""
    entries = []
    for key, lists in features:
        kinds = (("bytes_list", lambda v: b"".join(_field(1, x) for x in v)), ("float_list", lambda v: _field(1, np.array(v, "<f4").tobytes())), ("int64_list", lambda v: _field(1, b"".join(_number(x & (1 << 64) - 1) for x in v))))
        feature = next((_field(i, f(lists[k])) for i, (k, f) in enumerate(kinds, 1) if lists and lists[k]), b"")
        entries.append(_field(1, _field(1, key.encode()) + _field(2, feature)))
    return _field(1, b"".join(entries))


def _bounded(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The records of a batch, BATCH or about BATCH_BYTES at a time."""
    held, size = [], 0
    for row in batch.column("features"):
        held.append(encoded(row.as_py() or []))
        size += len(held[-1])
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Shard(WriterCommitMessage):
    name: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        where, base = _located(self.path)
        where.create_dir(f"{base}/{self.job}", recursive=True)
        name, n = uuid.uuid4().hex, 0
        with where.open_output_stream(f"{base}/{self.job}/{name}", compression=None) as raw, gzip.open(raw, "wb", compresslevel=LEVEL) as stream:
            for batch in iterator:
                for rows in _bounded(batch):
                    stream.write(framed(rows))
                    n += len(rows)
        return Shard(name, n)

    def commit(self, messages: list[Shard | None]) -> None:
        where, base = _located(self.path)
        shards = [m for m in messages if m is not None and m.records]
        if self.overwrite and where.get_file_info(base).type == fs.FileType.Directory:
            for f in where.get_file_info(fs.FileSelector(base)):
                if f.is_file:
                    where.delete_file(f.path)
        stem = self.job.rpartition("-")[2][:8]
        where.create_dir(base, recursive=True)
        for i, m in enumerate(shards):
            where.move(f"{base}/{self.job}/{m.name}", f"{base}/{stem}-{i:05d}-of-{len(shards):05d}.gz")
        self._clean(where, base)

    def abort(self, messages: list[Shard | None]) -> None:
        self._clean(*_located(self.path))

    def _clean(self, where: fs.FileSystem, base: str) -> None:
        if where.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/{self.job}")
