"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared with A-Z lowered and white space collapsed to one space. Each benchmark item is cut to
overlapping pieces of `piece` bytes, every `piece` / 2 (shorter items are one piece). A piece of m bytes
that occurs in a text with at most e edits shares at least m - q + 1 - q e of its q-grams with it (the q-gram
lemma), all on diagonals at most e from each other. A piece may have up to `rate` of its bytes edited, rounded down; where it is too short
for the lemma to allow that at q, its own q is the largest that does. For the pieces of each q:

* every q-gram of every text is looked up in a bitmap of the benchmark's q-grams, then in their sorted list;
* hits are counted in bands of diagonals 2 (e + 1) wide that overlap by half, so any e + 1 neighbouring
  diagonals lie in one band;
* bands that reach the bound are verified by banded alignment of the piece against the text there, with free ends in the text, many at once.

Pieces that several items have in common are one piece. A q-gram of more than FREQUENT pieces (an instruction that items share) is not counted for each of them, but once
for each of their layouts, a layout being the places of all such q-grams in a piece: pieces of one layout have the same count on a band, so what is
expanded to single pieces are rare q-grams and the bands to be verified. Equal windows of a text are verified once.

A text is contaminated if a piece passes. The benchmark's pieces travel to all tasks as text, and each worker builds the index (about 25 bytes for each byte). A
benchmark of over MOST_BYTES goes in parts. Items shorter than a piece (as a rule few bytes in all) are looked for in all texts; for the others one pass finds the texts with
enough q-grams of any (a bitmap of 32 MB), and each part's pass reads those only.

Defined cases: null or empty texts and items match nothing. Items too short for an edit (under 1 / `rate` bytes) have to match exactly, those of `q` bytes or fewer moreover as whole words. Items with a null item_id are items of their own, with a null
item_id in the result, and so are documents with a null doc_id. Repeated rows each give their matches. Other columns are ignored. An empty table gives no rows. Texts of any
length are read whole, in some 30 bytes for each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import LOWER, SEPARATOR, mix, pieces, stretch_hashes, texts

MOST_BYTES = 4 << 20
FREQUENT = 16
_BITS = 22
_AT_ONCE = 1 << 20  # hits expanded at once
_ALIGNED = 4096  # alignments at once


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case, one space for each stretch of white space."""
    space = SEPARATOR[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    out = LOWER[data]
    out[space] = 32
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The hash of the q bytes from each place on, for q <= 16: its first and its last 8 bytes, or all of fewer."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.ascontiguousarray(data) if q >= 8 else np.concatenate([data, np.zeros(8 - q, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    word = np.ascontiguousarray(eight).view(np.uint64).ravel()
    if q < 8:
        return mix((word & np.uint64((1 << 8 * q) - 1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (word[q - 8 : q - 8 + n] + np.uint64(0x632BE59BD9B4E019)))


Cut = dict[tuple[bytes, int, int], list[tuple[tuple[bool, int], int]]]  # (piece, edits, q): the items that hold it, with how many pieces each has


def cut(items: list[tuple[int | None, str]], piece: int, rate: float, q: int) -> Cut:
    """The benchmark's distinct pieces, each with its own q: the largest up to `q` at which the lemma allows the piece's whole budget of edits."""
    out: Cut = {}
    for place, (item, text) in enumerate(items):
        key = (item is None, place if item is None else item)
        raw = (text or "").encode()
        data, _ = normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        data = data.tobytes().strip()
        if not data:
            continue
        cuts = [*range(0, max(1, len(data) - piece + 1), piece // 2)]
        if cuts[-1] + piece < len(data):
            cuts.append(len(data) - piece)
        for a in cuts:
            own = data[a : a + piece]
            e = int(rate * len(own))
            out.setdefault((own, e, min(q, len(own) // (e + 1))), []).append((key, len(cuts)))
    return out


class Grams:
    """Sorted q-gram hashes, and the owner and place of each."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, place: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order].astype(np.int32), place[order].astype(np.int32)

    def hits(self, h: np.ndarray, at: np.ndarray):
        """(place in the text, owner, place in the owner) of all hits, some at a time."""
        if not len(self.hashes):
            return
        left = np.searchsorted(self.hashes, h, "left")
        times = np.searchsorted(self.hashes, h, "right") - left
        at, left, times = at[times > 0], left[times > 0], times[times > 0]
        until = np.cumsum(times)
        start = 0
        while start < len(at):
            end = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + _AT_ONCE, "right")))
            own = times[start:end]
            which = np.repeat(left[start:end] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            yield np.repeat(at[start:end], own), self.owner[which], self.place[which]
            start = end


class Pieces:
    """Pieces of the benchmark of one q, indexed: rare q-grams by piece, frequent ones by layout."""

    def __init__(self, some: Cut, q: int):
        own = [(t, e, items) for (t, e, q_), items in some.items() if q_ == q]
        self.q, self.items = q, [sorted(set(items)) for _, _, items in own]
        self.text = [np.frombuffer(t, np.uint8) for t, _, _ in own]
        self.edits, self.length = np.array([e for _, e, _ in own], np.int64), np.array([len(t) for t in self.text], np.int64)
        self.bound = self.length - q + 1 - q * self.edits
        each = [grams(t, q) for t in self.text]
        size = np.array([len(g) for g in each], np.int64)
        hashes, piece = np.concatenate([*each, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(each)), size)
        place = np.concatenate([*map(np.arange, size), np.zeros(0, np.int64)])
        known, which = np.unique(hashes, return_inverse=True)
        holders = np.bincount(np.unique(which * len(each) + piece) // max(len(each), 1), minlength=len(known))
        often = holders[which] > FREQUENT
        self.rare = Grams(hashes[~often], piece[~often], place[~often])
        #: Layouts: pieces with the same frequent q-grams in the same places, and the same length and edits. Layout 0 has none.
        cuts, names = np.concatenate([[0], np.cumsum(size)]), {}
        layout, first = [], []
        for i in range(len(each)):
            mine = often[cuts[i] : cuts[i + 1]]
            name = (int(self.length[i]), int(self.edits[i]), mine.tobytes(), each[i][mine].tobytes()) if mine.any() else None
            if name is not None and name not in names:
                names[name] = len(names) + 1
                first.append(i)
            layout.append(names.get(name, 0))
        self.layout = np.array(layout, np.int64)
        self.first = np.array([0, *first], np.int64)
        self.members = np.argsort(self.layout, kind="stable")
        self.member_cut = np.searchsorted(self.layout[self.members], np.arange(len(self.first) + 1))
        shown = np.zeros(len(hashes), bool)
        for i in first:
            shown[cuts[i] : cuts[i + 1]] = often[cuts[i] : cuts[i + 1]]
        self.often = Grams(hashes[shown], self.layout[piece[shown]], place[shown])
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[known >> np.uint64(64 - _BITS)] = True


def index(some: Cut) -> list[Pieces]:
    return [Pieces(some, q) for q in sorted({q for _, _, q in some})]


def _counted(hits, owners: int, edits: np.ndarray, slack: int, over: int, document: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (document, owner, band of diagonals) and how many hits each has."""
    keys, counts = [], []
    for at, owner, place in hits:
        half = edits[owner] + 1
        band = (at - place + slack + over * half) // (2 * half)
        key, n = np.unique((document[at].astype(np.int64) * owners + owner) * bands + band, return_counts=True)
        keys.append(key)
        counts.append(n)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(which, np.concatenate(counts)).astype(np.int64)


def aligned(patterns: np.ndarray, windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The least edits of each pattern against any stretch of its window, and that stretch's end in the window, within the diagonals 0 to
    windows' width - patterns' width; over `most`: most + 1. A row a pattern; 0xFF in a window equals nothing."""
    n, m = patterns.shape
    width = windows.shape[1] - m + 1
    steps = np.arange(width, dtype=np.int16)
    row, open_ = np.zeros((n, width), np.int16), np.arange(n)
    edits, end = np.full(n, most + 1, np.int64), np.zeros(n, np.int64)
    for i in range(m):
        new = row + (windows[:, i : i + width] != patterns[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % 8 == 7:
            on = row.min(axis=1) <= most
            if not on.all():
                row, windows, patterns, open_ = row[on], windows[on], patterns[on], open_[on]
                if not len(open_):
                    return edits, end
    edits[open_], end[open_] = np.minimum(row.min(axis=1), most + 1), row.argmin(axis=1) + m
    return edits, end


def _candidates(h: np.ndarray, at: np.ndarray, b: Pieces, document: np.ndarray, slack: int, over: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, band) that reach the bound."""
    owners, bands = max(len(b.text), len(b.first)), int(at.max() if len(at) else 0) + slack + 8 * (int(b.edits.max()) + 1)
    key, n = _counted(b.rare.hits(h, at), owners, b.edits, slack, over, document, bands)
    layout_key, layout_n = _counted(b.often.hits(h, at), owners, b.edits[b.first], slack, over, document, bands)
    pair, band = key // bands, key % bands
    doc, piece = pair // owners, pair % owners
    if len(layout_key):
        also = (doc * owners + b.layout[piece]) * bands + band
        place = np.minimum(np.searchsorted(layout_key, also), len(layout_key) - 1)
        n = n + np.where((layout_key[place] == also) & (b.layout[piece] > 0), layout_n[place], 0)
    ok = n >= b.bound[piece]
    doc, piece, band = doc[ok], piece[ok], band[ok]
    some = layout_key[layout_n >= b.bound[b.first[layout_key // bands % owners]]]  # frequent q-grams alone suffice: all pieces of the layout
    which = some // bands % owners
    size = b.member_cut[which + 1] - b.member_cut[which]
    more = b.members[np.repeat(b.member_cut[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return np.concatenate([doc, np.repeat(some // bands // owners, size)]), np.concatenate([piece, more]), np.concatenate([band, np.repeat(some % bands, size)])


def _whole_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether no letter or digit stands right before or after a stretch of a document (low to high)."""
    inside = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
    return ~((start > low) & inside[data[np.maximum(start - 1, 0)]]) & ~((end < high) & inside[data[np.minimum(end, len(data) - 1)]])


def matches(data: np.ndarray, offsets: np.ndarray, b: Pieces) -> list[tuple[int, int, int, int, int]]:
    """(document, piece, start, end, edits) in normalised texts that lie one after another; the best place of each piece in each document."""
    h = grams(data, b.q)
    at = np.flatnonzero(b.bitmap[h >> np.uint64(64 - _BITS)])
    document = np.searchsorted(offsets, at, "right") - 1
    at = at[at + b.q <= offsets[document + 1]]
    if not len(at):
        return []
    where = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    found: dict[tuple[int, int], tuple[int, int, int]] = {}

    def keep(docs, own, starts, ends, edits):
        for d, p, s, z, e in zip(docs.tolist(), own.tolist(), starts.tolist(), ends.tolist(), edits.tolist()):
            if (d, p) not in found or (e, s) < (found[d, p][2], found[d, p][0]):
                found[d, p] = (s, z, e)

    slack = int(b.length.max()) + 1  # diagonals are never negative with it
    for over in (0, 1):
        doc, piece, band = _candidates(h[at], at, b, where, slack, over)
        e, m = b.edits[piece], b.length[piece]
        low = band * 2 * (e + 1) - over * (e + 1) - slack  # the band's first diagonal
        for edits, size in sorted(set(zip(e.tolist(), m.tolist()))):
            own = np.flatnonzero((e == edits) & (m == size))
            a, width = low[own] - edits, size + 4 * edits + 2
            z = a + width
            lo, hi = offsets[doc[own]], offsets[doc[own] + 1]
            seen = stretch_hashes(data, np.maximum(a, lo), np.maximum(np.minimum(z, hi), np.maximum(a, lo))) + np.maximum(lo - a, 0).astype(np.uint64)
            order = np.lexsort((a, seen, piece[own], doc[own]))
            new = np.ones(len(order), bool)
            for x in (doc[own], piece[own], seen):
                new[1:] &= x[order][1:] == x[order][:-1]
            new[1:] = ~new[1:]
            pick = order[new]
            for part in np.array_split(pick, -(-len(pick) // _ALIGNED)):
                i = own[part]
                place = a[part][:, None] + np.arange(width)
                inside = (place >= lo[part][:, None]) & (place < hi[part][:, None])
                windows = np.where(inside, data[np.where(inside, place, 0)], 255).astype(np.uint8)
                got, end = aligned(np.stack([b.text[p] for p in piece[i].tolist()]), windows, edits)
                ok = got <= edits
                z = np.minimum(a[part] + end, hi[part])
                start = np.maximum(z - size, lo[part])
                if size == b.q:  # so short that it has to stand alone
                    ok &= _whole_words(data, start, z, lo[part], hi[part])
                keep(doc[i][ok], piece[i][ok], (start - lo[part])[ok], (z - lo[part])[ok], got[ok])
    return [(d, p, *x) for (d, p), x in found.items()]


_built: dict[int, list[Pieces]] = {}


def _indexed(shipped) -> list[Pieces]:
    """A worker's index of the part it works on."""
    key = hash(frozenset(shipped.value))
    if key not in _built:
        _built.clear()
        _built[key] = index(shipped.value)
    return _built[key]


_KINDS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "start", "end", "edits", "n_pieces", "of_pieces", "n_items")])


def _scan(shipped):
    def scan(batches):
        for batch in pieces(batches):
            data, offsets = normalised(*texts(batch.column("text")))
            ids, rows = batch.column("doc_id").to_pylist(), {}
            found = [(len(b.items[own]), at, b.items[own], x) for b in _indexed(shipped) for at, own, *x in matches(data, offsets, b)]
            for n, at, items, (start, end, edits) in sorted(found, key=lambda f: f[:2]):  # what one item alone holds first
                mine = rows.setdefault(at, {})
                for item, of in [i for i in items if i[0] in mine] or items[:1]:
                    was = mine.get(item, (start, end, 0, 0, of, n))
                    mine[item] = (min(start, was[0]), max(end, was[1]), was[2] + edits, was[3] + 1, of, max(n, was[5]))
            out = [(ids[at], None if nameless else item, *x) for at, mine in sorted(rows.items()) for (nameless, item), x in sorted(mine.items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)], schema=_KINDS)

    return scan


def _suspects(docs: DataFrame, items: DataFrame, piece: int, rate: float, q: int) -> DataFrame:
    """The documents with as many q-grams of `items` (none shorter than a piece) as a match needs."""
    spark, e = docs.sparkSession, int(rate * piece)
    q = min(q, piece // (e + 1))
    bits = 1 << 28

    def slots(batches):
        for batch in pieces(batches):
            h = grams(normalised(*texts(batch.column("text")))[0], q)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h >> np.uint64(36)).astype(np.int64))], names=["slot"])

    maps = items.mapInArrow(slots, "slot long").groupBy(F.floor(F.col("slot") / 32768).alias("g")).agg(F.call_function("bitmap_construct_agg", F.col("slot") % 32768).alias("m")).collect()
    bitmap = np.zeros(bits // 8, np.uint8)  # 32 MB
    for g, m in maps:
        bitmap[g * 4096 : (g + 1) * 4096] = np.frombuffer(m, np.uint8)
    shipped = spark.sparkContext.broadcast(bitmap)

    def suspect(batches):
        for batch in pieces(batches):
            data, offsets = normalised(*texts(batch.column("text")))
            slot = (grams(data, q) >> np.uint64(36)).astype(np.int64)
            hit = np.concatenate([[0], np.cumsum(shipped.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)])
            n = hit[np.minimum(offsets[1:], len(slot))] - hit[np.minimum(offsets[:-1], len(slot))]
            yield batch.filter(pa.array(n >= piece - q + 1 - q * e))

    return shared.settle(docs.mapInArrow(suspect, docs.schema), "suspects")


def contamination(docs: DataFrame, benchmark: DataFrame, piece: int = 80, rate: float = 0.07, q: int = 12) -> DataFrame:
    """A row for each document and benchmark item with a piece in common: doc_id, item_id, start and end of what
    matched (bytes of the normalised text), edits, n_pieces of the item's of_pieces, and n_items. Of a piece that several items hold, those count that match elsewhere in the document
    too, else the least of them alone; n_items tells how many hold it, and `holders` which."""
    spark = docs.sparkSession
    shared.tune(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    size = lambda rows: rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, large = [(docs, items)], size(items) > MOST_BYTES
    if large:
        length = F.octet_length(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
        groups = [(docs, items.where(length < piece)), (_suspects(docs, items.where(length >= piece), piece, rate, q), items.where(length >= piece))]
    out = None
    for rows, some in groups:
        parts = -(-size(some) // MOST_BYTES) or 1
        for part in range(parts):
            own = some if parts == 1 else some.where(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(parts)) == part)
            shipped = spark.sparkContext.broadcast(cut([tuple(r) for r in own.orderBy("item_id", "text").collect()], piece, rate, q))
            one = rows.mapInArrow(_scan(shipped), "doc_id long, item_id long, start long, end long, edits long, n_pieces long, of_pieces long, n_items long")
            if large:  # one part of the benchmark is held in memory at a time
                one = shared.settle(one, "found")
                shipped.destroy()
            out = one if out is None else out.union(one)
    return out


def holders(benchmark: DataFrame, piece: int = 80, rate: float = 0.07, q: int = 12) -> DataFrame:
    """item_id and least_id: the items that share a piece with a lesser item, for each the least one of each such piece."""

    def own(batches):
        for batch in batches:
            rows = [(i, t, e) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()) for t, e, _ in cut([(i, text)], piece, rate, q)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "piece"])

    held = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL").mapInArrow(own, "item_id long, piece binary")
    held = held.withColumn("piece", F.sha2("piece", 256))
    return held.join(held.groupBy("piece").agg(F.min("item_id").alias("least_id")), "piece").where("item_id <> least_id").select("item_id", "least_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which nothing of the benchmark was found; those without doc_id are told apart by their text."""
    every = shared.named(docs)
    return shared.as_named(shared.without(every, "doc_id", shared.settle(contamination(every, benchmark).select("doc_id").distinct(), "contaminated")), docs)
