"""Token-ID output: Parquet list columns with dictionary and delta encodings, controlled row groups and page indexes.

The files hold doc_id, part (the file's place in document order), offset (ids before it in its file), n_tokens and ids.
Ids are dictionary-encoded, the sorted columns doc_id and offset delta-encoded. Row groups end at `row_group_bytes`, pages at
`page_rows` rows, and Parquet's column and offset indexes (which Spark's writer always adds) let a reader with a
filter on doc_id fetch only some pages, and a reader of metadata skip the ids.

Documents are range-partitioned by doc_id (rows of one doc_id also by a hash of their text, so many of them are no hot key) and sorted, so files
follow each other in ascending order. No total order is made in one task: a file's base is the sum of the ids in the files
before it, and a small table of bases, `_bases`, stands beside the files.

A text is encoded piece by piece, each distinct piece once per cache, if the tokenizer splits texts as PIECEWISE says; with any other the
library encodes whole texts. Such a tokenizer splits at white space and drops it, and between
letters and other characters, and lower-cases, so pieces are words in lower case, cut further where an ASCII letter meets another ASCII
character that is no apostrophe, and where a letter from U+00C0 to U+00FF is followed by an ASCII character that is neither. The ids are those of the whole text; a batch of texts that holds "<|", with which special tokens begin, is
encoded by whole words as they are.

Defined cases: null counts as empty and gives the end id alone. Rows with equal ids are ordered by a hash of their text, then the text; null ids come first. Other columns
are ignored. An empty table gives empty files and no rows. Texts of any length are encoded whole. Pieces are told apart by 64-bit hashes (see `words`).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .words import _MASKS, _ODD, _STRETCH, LOWER, SEPARATOR, Words, mix, pieces, stretch_hashes, texts

_SCHEMA = "doc_id long, part int, offset long, n_tokens int, ids array<int>"


# How a tokenizer file has to normalise and split for texts to be encoded piece by piece.
PIECEWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_into_pieces(tokenizer) -> bool:
    """Whether the ids of a text are those of its pieces, one after another, and a run of letters ends with a token that ends words."""
    told = json.loads(tokenizer.to_str())
    model = told["model"]
    alone = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in told["added_tokens"])
    return alone and all(told[k] == v for k, v in PIECEWISE.items()) and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]


class TextEncoder:
    """Ids of whole texts, for any tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.cumsum([0, *map(len, ids)])


class Pieces(Words):
    """The pieces of lower-cased texts, as words. Eight zeros stand after their bytes."""

    def __init__(self, data: bytes, offsets: np.ndarray):
        self.data, self.offsets = np.frombuffer(data + bytes(8), np.uint8), offsets
        kind = np.zeros(len(data) + 2, np.uint8)
        kind[1:-1] = kinds(data)
        self.kinds = kind[1:]
        turn = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(_TURNS), np.uint8)
        begins, stops = (turn & 1).view(bool), (turn >> 1).view(bool)
        inner = offsets[1:-1]
        inner = inner[(kind[inner] > 0) & (kind[inner + 1] > 0)]  # no piece reaches over the end of its text
        begins[inner] = stops[inner] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops)
        self._count()

    def hashes(self) -> np.ndarray:
        """The same hashes as those of words, by a shorter way for pieces of up to 8 bytes."""
        out = np.empty(len(self.starts), np.uint64)
        at_byte = np.ndarray((len(self.data) - 7,), np.uint64, self.data.data, 0, (1,))
        for i in range(0, len(out), _STRETCH):
            starts, left = self.starts[i : i + _STRETCH], self.ends[i : i + _STRETCH] - self.starts[i : i + _STRETCH]
            own = left.astype(np.uint64)
            own *= _ODD
            own ^= at_byte[starts] & _MASKS[np.minimum(left, 8)]
            own = mix(own)
            more = np.flatnonzero(left > 8)
            own[more] = stretch_hashes(self.data, starts[more], starts[more] + left[more])
            out[i : i + _STRETCH] = own
        return out


def kinds(data: bytes) -> np.ndarray:
    """The kind of each byte of lower-cased texts: 0 separates, 1 a to z, 2 other ASCII, 4 and 5 the two bytes of a letter from U+00C0 to U+00FF, 3 anything else (apostrophes as well)."""
    kind = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    if not data.isascii():
        d = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero(d == 0xC3)
        lead = lead[(d[lead + 1] != 0x97) & (d[lead + 1] != 0xB7)]
        kind[lead], kind[lead + 1] = 4, 5
    return kind


def _turns(before: int, after: int) -> int:
    """Whether a piece begins (1) and ends (2) between two kinds of bytes."""
    cut = (before, after) in ((1, 2), (2, 1), (5, 2))
    return bool(after and (cut or not before)) + 2 * bool(before and (cut or not after))


_LOWER = LOWER.tobytes()
_KINDS = bytes(0 if SEPARATOR[c] else 1 if 97 <= c <= 122 else 3 if c == 39 or c >= 128 or 65 <= c <= 90 else 2 for c in range(256))
_TURNS = bytes(_turns(c >> 3, c & 7) for c in range(64)) + bytes(192)
_LATIN_LOWER = re.compile(b"\xc3[\x80-\x96\x98-\x9e]")


class WordEncoder:
    """Ids of words, with a cache of at most `most` distinct words: a hash table with linear probing, kept at most half full.

    A slot holds a word's hash and its place: where its ids begin in `pool` (never at 0, so 0 is an empty slot), times 2**32, plus how many they are. A full cache keeps the words that
    were met again since they came or since it was last full, if they are no more than half.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        self.tokenizer, self.most = tokenizer_of(path), most
        if not splits_into_pieces(self.tokenizer):
            raise ValueError(f"{path} does not split texts into pieces as expected")
        self.letters = letters_only(self.tokenizer)
        self.slots = 1 << (2 * most - 1).bit_length()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token ends a run of letters: such runs can share a call, and be told apart after it.
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.table, self.count = np.zeros((self.slots, 2), np.uint64), 0
        self.pool, self.again, self.used = np.zeros(1, np.int32), np.zeros(1, bool), 1

    def _prune(self) -> None:
        """Forget the words that were not met again, or all if too many were."""
        rows = self.table[self.table[:, 1] > 0]
        rows = rows[self.again[rows[:, 1] >> _PLACE]]
        pool = self.pool
        self._clear()
        if len(rows) <= self.most // 2:
            size = (rows[:, 1] & _SIZE).astype(np.int64)
            self._add(rows[:, 0], pool[_ranges(rows[:, 1] >> _PLACE, size)], size)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin and end."""
        return self.encode(self.cut(column))

    def cut(self, column: pa.Array) -> Words:
        """The pieces of texts, as words."""
        data, offsets = texts(column)
        data = data.tobytes()
        return Words(column) if b"<|" in data else Pieces(data.translate(_LOWER), offsets)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or 0."""
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        rows = self.table.take(slot, axis=0)
        place = rows[:, 1].copy()
        open_ = np.flatnonzero(rows[:, 0] != keys)
        while len(open_):
            open_ = open_[place[open_] > 0]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            rows = self.table.take(slot[open_], axis=0)
            place[open_] = rows[:, 1]
            open_ = open_[rows[:, 0] != keys[open_]]
        return place

    def _add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """New distinct keys, and their ids one after another."""
        if self.used + len(flat) >= len(self.pool):  # the last word's place is within, even without ids
            more = self.used + 2 * len(flat)
            self.pool, self.again = np.concatenate([self.pool[: self.used], np.zeros(more, np.int32)]), np.concatenate([self.again[: self.used], np.zeros(more, bool)])
        self.pool[self.used : self.used + len(flat)] = flat
        place = ((self.used + np.cumsum(size) - size).astype(np.uint64) << _PLACE) | size.astype(np.uint64)
        self.used += len(flat)
        self.count += len(keys)
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(keys):
            free = self.table[slot, 1] == 0
            self.table[slot[free], 0] = keys[free]
            mine = free & (self.table[slot, 0] == keys)  # of keys that want one slot the last written has it
            self.table[slot[mine], 1] = place[mine]
            keys, place, slot = keys[~mine], place[~mine], (slot[~mine] + 1) & (self.slots - 1)

    def _learn(self, w: Words, keys: np.ndarray, example: np.ndarray) -> None:
        """Encode new words, given by a place of each in w."""
        starts, ends = w.starts[example], w.ends[example]
        raw = w.data.tobytes()
        odd = np.cumsum(((w.kinds if isinstance(w, Pieces) else kinds(raw)) & 6) == 2, dtype=np.int32)
        odd = np.concatenate([[0], odd])
        run = odd[ends] == odd[starts]
        keys = np.concatenate([keys[run], keys[~run]])
        flat, size = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if run.any():
            together = b" ".join([raw[a:b] for a, b in zip(starts[run].tolist(), ends[run].tolist())])
            together = _LATIN_LOWER.sub(lambda m: bytes([0xC3, m[0][1] + 32]), together)
            flat = np.array(self.letters.encode_batch_fast([together.decode()], add_special_tokens=False)[0].ids, np.int32)
            size = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if not run.all():
            rest = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[~run].tolist(), ends[~run].tolist())], add_special_tokens=False)]
            size = np.concatenate([size, np.fromiter(map(len, rest), np.int64, len(rest))])
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), np.int32)])
        self._add(keys, flat, size)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents of w, and where each document's begin and end."""
        hashes = w.hashes()
        place = self._find(hashes)
        new = np.flatnonzero(place == 0)
        self.again[place >> _PLACE] = True
        if len(new):
            keys, example = np.unique(hashes[new], return_index=True)
            if self.count + len(keys) > self.most:
                self._prune()
                place = self._find(hashes)
                new = np.flatnonzero(place == 0)
                keys, example = np.unique(hashes[new], return_index=True)
            if self.count + len(keys) > self.most:
                new = np.arange(len(hashes))
                keys, example = np.unique(hashes, return_index=True)
                if len(keys) > self.most:
                    self.slots = 1 << (4 * len(keys)).bit_length()
                    self.most = self.slots // 2
                self._clear()
            self._learn(w, keys, new[example])
            place[new] = self._find(hashes[new])
        size = (place & _SIZE).astype(np.int64)
        return self.pool[_ranges(place >> _PLACE, size)], np.concatenate([[0], np.cumsum(size)])[w.first]


#: A place holds where ids begin above this bit, and how many they are below.
_PLACE, _SIZE = np.uint64(32), np.uint64((1 << 32) - 1)


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from at[i] to at[i] + size[i] - 1, for each i."""
    until = np.cumsum(size)
    return np.repeat(at.astype(np.int64) - until + size, size) + np.arange(until[-1] if len(until) else 0)


def letters_only(tokenizer):
    """The tokenizer's model for lower-case letters a to z and U+00DF to U+00FF with single spaces between runs: of such a text its normalizer changes nothing, and its pattern makes each run a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
    return bare


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """A worker's encoder; its cache serves all its tasks."""
    if path not in _encoders:
        _encoders.clear()
        try:
            _encoders[path] = WordEncoder(path)
        except ValueError:
            _encoders[path] = TextEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def encode(batches):
        from pyspark import TaskContext

        part, offset = TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            ids, cut = encoder(path).texts(batch.column("text"))
            ids = np.insert(ids, cut[1:], end_id)
            cut = cut + np.arange(len(cut))
            size = np.diff(cut)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(size), part, np.int32)), pa.array(offset + cut[:-1]), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(cut.astype(np.int32), ids.astype(np.int32))],
                names=["doc_id", "part", "offset", "n_tokens", "ids"],
            )
            offset += int(cut[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, row_group_bytes: int = 32 << 20, page_rows: int = 256) -> None:
    """Encode every text of `docs` (doc_id, text) and write the files to `path`. `tokenizer`: a file of the tokenizers library."""
    shared.tune(docs.sparkSession)
    order = ["doc_id", "place", "text"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("place", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "place").sortWithinPartitions(*order).drop("place")
    out = rows.mapInArrow(_encode(tokenizer, end_id), _SCHEMA).write.option("compression", "zstd")
    for k, v in {
        "parquet.writer.version": "v2",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#offset": "false",
    }.items():
        out = out.option(k, v)
    out.parquet(path)
    sizes = docs.sparkSession.read.schema(_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("size"))
    base = F.sum("size").over(Window.orderBy("part")) - F.col("size")  # a row a file
    sizes.select("part", base.alias("base")).coalesce(1).write.parquet(f"{path}/_bases")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; select and filter to read only some columns and pages.

    The bases are broadcast: two numbers for each file, and files are as many as write_tokens had partitions at most.
    """
    rows, bases = spark.read.schema(_SCHEMA).parquet(path), spark.read.schema("part int, base long").parquet(f"{path}/_bases")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long"), "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC of the ids as little-endian 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
