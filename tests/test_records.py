"""Records and forests decoded in bulk against a plain decoder, a byte at a time, and shards written with a commit."""

import gzip
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from trajspark.sources import records, wire


def fields(data):
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise OSError
        yield tag >> 3, kind, data[at : at + size]
        at += size


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def plain_example(data):
    out = {}
    for _, _, whole in fields(data):
        for _, _, entry in fields(whole):
            parts = {n: v for n, _, v in fields(entry)}
            lists = [[], [], []]
            for n, _, inner in fields(parts.get(2, b"")):
                for _, kind, v in fields(inner):
                    if n == 1:
                        lists[0].append(v)
                    elif n == 2:
                        lists[1] += [x for (x,) in struct.iter_unpack("<f", v)]
                    elif kind == 2:
                        value = shift = 0
                        for byte in v:
                            value |= (byte & 127) << shift
                            shift += 7
                            if byte < 128:
                                lists[2].append(signed(value))
                                value = shift = 0
                    else:
                        lists[2].append(signed(v))
            out[parts[1].decode()] = lists
    return out


def plain_nodes(forest):
    out = []
    try:
        for number, _, window in fields(forest):
            for inner, _, tree in fields(window) if number == records.WINDOWS else ():
                for n, _, node in fields(tree) if inner == records.TREE else ():
                    if n != records.NODES:
                        continue
                    row = {"unique_id": 0, "bounds": dict.fromkeys(records.SIDES.values(), 0), "depth": 0} | {k: "" for k in ("text", "content_description", "view_id_resource_name", "class_name")}
                    row |= {k: False for k in records.NODE.values() if k.startswith("is_")}
                    for k, _, v in fields(node):
                        name = records.NODE.get(k)
                        if name == "bounds":
                            row[name] |= {records.SIDES[i]: signed(x) for i, _, x in fields(v) if i in records.SIDES}
                        elif name:
                            row[name] = v.decode("utf-8", "replace") if isinstance(v, bytes) else v != 0 if name.startswith("is_") else signed(v)
                    out.append(row)
    except (OSError, IndexError, TypeError, KeyError, AttributeError):
        return []
    return out


def number(v):
    v &= (1 << 64) - 1
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def message(*parts):
    return b"".join(number(n << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(n << 3) + number(v) for n, v in parts)


def random_node(rng):
    text = rng.choice(["", "Send", "é" * 40, "x" * 300]).encode() if rng.random() < 0.9 else b"\xff\xfeab"
    box = message(*[(rng.randint(1, 5), rng.randint(-3000, 3000)) for _ in range(rng.randint(0, 6))])
    parts = [(1, rng.randint(-5, 10**6)), (2, box), (3, b"android.widget.Button"), (4, b"said"), (7, text), (10, b"app:id/send"), (14, rng.randint(0, 2)), (15, 0), (19, 1), (23, 1), (27, rng.randint(0, 9)), (40, b"other"), (41, 7)]
    return message(*[p for p in parts if rng.random() < 0.8])


def random_forest(rng):
    trees = [message((3, 1), (11, message(*[(rng.choice([1, 1, 1, 2]), random_node(rng)) for _ in range(rng.randint(0, 30))]))) for _ in range(rng.randint(0, 3))]
    forest = message(*[(1, t) for t in trees], (9, 4))
    spoilt = rng.random()
    if spoilt < 0.1:
        return forest[: rng.randint(0, len(forest))]
    if spoilt < 0.15:
        return b"\xff\xff"
    return forest if spoilt > 0.2 else forest + message((1, 5))


def test_forests_against_a_plain_decoder():
    rng = random.Random(2)
    forests = [random_forest(rng) for _ in range(150)] + [b"", None]
    for size in (1, 7, 200):  # few messages go on by themselves, many in step
        for at in range(0, len(forests), size):
            own = forests[at : at + size]
            assert records.forest_nodes(pa.array(own, pa.binary())).to_pylist() == [plain_nodes(f or b"") for f in own]
    sliced = pa.array([b"zz", *forests], pa.binary())[5:60]
    assert records.forest_nodes(sliced).to_pylist() == [plain_nodes(f or b"") for f in forests[4:59]]


def test_examples_against_a_plain_decoder():
    rng = random.Random(4)

    def feature():
        kind = rng.randint(0, 4)
        if kind == 0:
            return message((1, message(*[(1, rng.randbytes(rng.randint(0, 300))) for _ in range(rng.randint(0, 4))])))
        if kind == 1:
            return message((2, message((1, struct.pack(f"<{(n := rng.randint(0, 5))}f", *[rng.random() for _ in range(n)])))))
        if kind == 2:
            return message((3, message((1, b"".join(number(rng.choice([0, 5, -1, 1 << 40])) for _ in range(rng.randint(0, 5)))), (1, 77))))
        return b"" if kind == 3 else message((3, message((1, -9), (1, 8))))

    data = [message((1, message(*[(1, message((1, rng.choice("abcdef").encode() * rng.randint(1, 40)), (2, feature()))) for _ in range(rng.randint(0, 20))]))) for _ in range(60)]
    found, broken = records.examples(pa.array(data, pa.large_binary()))
    assert not broken.any()
    for row, raw in zip(found, data):
        want = plain_example(raw)
        got = {k: [v["bytes_list"], [np.float32(x) for x in v["float_list"]], v["int64_list"]] for k, v in row.as_py()}
        assert got == {k: [a, [np.float32(x) for x in b], c] for k, (a, b, c) in want.items()}
    assert records.examples(pa.array([data[0], data[1][:-1], message((1, 3))], pa.large_binary()))[1].tolist() == [False, True, True]


def test_checksums_in_chunks():
    def plain(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = random.Random(1)
    data = [b"", b"123456789", *[rng.randbytes(n) for n in (1, 255, 256, 257, 512, 3000)]]
    whole, ends = b"".join(data), np.cumsum([len(x) for x in data])
    assert all(records.checksum(x) == ((plain(x) >> 15 | plain(x) << 17) + 0xA282EAD8) & 0xFFFFFFFF for x in (*data, b"xy" * 10_000))
    assert wire.crc32c(np.frombuffer(whole, np.uint8), ends - [len(x) for x in data], ends).tolist() == [plain(x) for x in data]


def test_bulk_is_fast():
    """Several times the rows a second of the plain decoder, dictionaries turned to Arrow as well."""
    import time

    rng = random.Random(5)
    forests = [message(*[(1, message((11, message(*[(1, random_node(rng)) for _ in range(60)])))) for _ in range(2)]) for _ in range(60)]
    column = pa.array(forests * 5, pa.binary())
    kind = records.forest_nodes(column).type

    def rate(f, n):
        began = time.perf_counter()
        return n / (f() or time.perf_counter() - began)

    def plain():
        pa.array([plain_nodes(f) for f in forests], kind)

    def bulk():
        records.forest_nodes(column)

    assert rate(bulk, 300) > 2 * rate(plain, 60)


def test_writer(spark, tmp_path):
    spark.dataSource.register(records.RecordSource)
    kind = "features MAP<STRING, STRUCT<bytes_list:ARRAY<BINARY>, float_list:ARRAY<FLOAT>, int64_list:ARRAY<BIGINT>>>"
    rows = [({"id": (None, None, [i, -i, 1 << 40]), "é": ([b"x" * i, b""], None, None), "f": (None, [0.5, -2.0], None), "none": (None, None, None)},) for i in range(50)]
    path = str(tmp_path / "out")
    df = spark.createDataFrame(rows, kind).repartition(3)
    df.write.format("feature_records").mode("append").save(path)
    read = lambda: spark.read.format("feature_records").option("path", path).option("verify", "true").load()
    assert sorted((tuple(r.features["id"].int64_list), bytes(r.features["é"].bytes_list[0]), tuple(r.features["f"].float_list), r.features["none"].int64_list == []) for r in read().collect()) == sorted(((i, -i, 1 << 40), b"x" * i, (0.5, -2.0), True) for i in range(50))
    assert len(list((tmp_path / "out").iterdir())) == 3
    df.limit(5).write.format("feature_records").mode("overwrite").save(path)
    assert read().count() == 5
    # a task that fails leaves nothing behind
    from pyspark.sql import functions as F

    bad = df.where(F.when(F.col("features")["id"]["int64_list"][0] == 30, F.raise_error(F.lit("stop")).cast("boolean")).otherwise(True))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("feature_records").mode("append").save(path)
    assert read().count() == 5 and all(p.suffix == ".gz" for p in (tmp_path / "out").iterdir())
    whole = next(p for p in (tmp_path / "out").iterdir())
    raw = bytearray(gzip.decompress(whole.read_bytes()))
    raw[20] ^= 1
    whole.write_bytes(gzip.compress(bytes(raw)))
    with pytest.raises(Exception, match="wrong checksum"):
        read().collect()


def test_frames_of_a_batch_equal_single_ones(monkeypatch):
    import io

    data = [b"", b"a", b"xy" * 700, bytes(range(256)) * 3]
    whole = records.framed(data)
    assert whole == b"".join(records.frame(x) for x in data)
    monkeypatch.setattr(records, "BATCH", 3)
    held = list(records._held(io.BytesIO(whole), "s"))
    assert [len(h) for h in held] == [3, 1] and [b[:-4] for h in held for _, b in h] == data
    for h in held:
        records._checked(h, "s")
    with pytest.raises(OSError, match="data"):
        records._checked([(held[0][0][0], b"\0" + held[0][1][1])], "s")
