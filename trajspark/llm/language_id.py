"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

Training takes a bounded sample of labelled rows (about SAMPLE_DOCS documents, shared out over the languages, whole texts of at most
MOST_BYTES; a language without any such text gives its shortest) and runs on the driver; four fifths of it give the counts, one fifth calibrates. Every
language has its own model: absolute discounting, the highest order on counts, lower ones on continuation counts,
interpolated down to a uniform distribution. The models of all languages are stored together: for each order one sorted array of
n-gram hashes with a row of log-probabilities, a column a language, and one of contexts with log backoff weights.
A character costs one binary search where its n-gram is known, and another order's two where it isn't.

A text goes to the language with the lowest cross-entropy a character (ties: to the first in code point order). It
is rejected if it is null, has no letter, or if that cross-entropy is too high for its language and length. Calibration cuts
held-out texts to stretches of LENGTHS characters; a bound is the language's median at that length plus REACH times the distance from the medians to
the QUANTILE of all languages' stretches (at least LEAST_SPREAD, so that texts that switch between known languages are not rejected), interpolated between lengths by their logarithms.

Whole texts are scored, lower-cased, each stretch of characters that are no letters as one space; texts of over STRETCH bytes in stretches of about
that size, cut at white space and added up.

Defined cases: null, empty and letterless texts get `und` with score 0 and are rejected. Without one labelled row all
texts get `und`. Over MOST_LANGUAGES labels are an error. Repeated rows get equal results. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import SEPARATOR, mix, pieces, texts

ORDER = 5
SAMPLE_DOCS = 1200
MOST_BYTES = 50_000
MOST_LANGUAGES = 500
LENGTHS = tuple(8 << i for i in range(9))  # 8 to 2048 characters
QUANTILE, REACH = 0.99, 5.0
LEAST_SPREAD = 0.25
STRETCH = 1 << 19
SHARPNESS = 8.0
_B = 0x9E3779B97F4A7C15
_space = ord(" ")
_tables: list[np.ndarray] = []


def _characters() -> np.ndarray:
    """Each code point's lower case if it is a letter, else a space."""
    if not _tables:
        _tables.append(np.array([(ord(low) if len(low := c.lower()) == 1 else i) if (c := chr(i)).isalpha() else _space for i in range(0x110000)], np.uint32))
    return _tables[0]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters of texts in UTF-8, each text with a space before it, and the offsets of the texts."""
    raw = data.tobytes()
    try:
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    except UnicodeDecodeError:  # not UTF-8 somewhere: text by text
        each = [np.frombuffer(raw[a:z].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, z in zip(offsets, offsets[1:])]
        codes, cut = np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    codes = _characters()[codes]
    codes = np.insert(codes, cut[:-1], _space)
    cut = cut + np.arange(len(cut))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _space) | (codes[:-1] != _space)
    keep[cut[:-1]] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[cut]


def gram_hashes(codes: np.ndarray, order: int, place: np.ndarray) -> np.ndarray:
    """The hash of the last `order` characters up to each one; `place` is its place in its text, and what lies before a text counts as 0."""
    h = codes.astype(np.uint64) + np.uint64(1)
    total = h.copy()
    for back in range(1, min(order, len(h))):
        shifted = np.zeros(len(h), np.uint64)
        shifted[back:] = h[:-back]
        shifted[place < back] = 0
        total += shifted * np.uint64(pow(_B, back, 1 << 64))
    return mix(total + np.uint64(order))


def places(cut: np.ndarray) -> np.ndarray:
    return np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))


def stretches(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with further cuts inside texts of over `most` bytes, after white space where there is some, and the text of each part."""
    if not len(offsets) > 1 or np.diff(offsets).max() <= most:
        return offsets, np.arange(len(offsets) - 1)
    cuts, of = [0], []
    for i, (a, z) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        while z - a > most:
            spaces = np.flatnonzero(SEPARATOR[data[a + most // 2 : a + most]])
            b = a + most // 2 + int(spaces[-1]) + 1 if len(spaces) else a + most
            while b < z and data[b] & 0xC0 == 0x80:
                b += 1
            cuts.append(b)
            of.append(i)
            a = b
        cuts.append(z)
        of.append(i)
    return np.array(cuts), np.array(of)


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order - 1
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoffs: list[np.ndarray]
    floor: float
    medians: np.ndarray | None = None  # by language and length
    spread: np.ndarray | None = None  # by length

    def score(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Log-probability of each character under each language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        open_ = np.arange(len(codes))
        hashes = gram_hashes(codes, ORDER, place)
        for order in range(ORDER, 0, -1):
            keys, h = self.keys[order - 1], hashes[open_]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            known = keys[at] == h
            out[open_[known]] += self.logs[order - 1][at[known]]
            open_ = open_[~known]
            if not len(open_):
                break
            if order > 1:
                hashes = gram_hashes(codes, order - 1, place)
                context = np.where(open_ > 0, hashes[open_ - 1], np.uint64(0))
                keys = self.contexts[order - 1]
                at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                known = keys[at] == context
                out[open_[known]] += self.backoffs[order - 1][at[known]]
            else:
                out[open_] += np.float32(self.floor)
        return out

    def totals(self, codes: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Minus log-probability of each text under each language; the leading space isn't predicted."""
        place, out = places(cut), np.zeros((len(cut) - 1, len(self.languages)))
        if len(codes):
            logs = self.score(codes, place).astype(np.float64)
            logs[place == 0] = 0
            some = np.flatnonzero(np.diff(cut) > 0)
            out[some] = -np.add.reduceat(logs, cut[some], axis=0)
        return out

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: cross-entropy a character under each language, characters, and whether it has a letter."""
        parts, of = stretches(data, offsets, STRETCH)
        n = len(offsets) - 1
        total, size, spoken = np.zeros((n, len(self.languages))), np.zeros(n, np.int64), np.zeros(n, bool)
        first = 0
        while first < len(of):
            last = max(first + 1, int(np.searchsorted(parts, parts[first] + STRETCH, "right")) - 1)
            codes, cut = letters(data[parts[first] : parts[last]], parts[first : last + 1] - parts[first])
            np.add.at(total, of[first:last], self.totals(codes, cut))
            np.add.at(size, of[first:last], np.maximum(np.diff(cut) - 1, 0))
            count = np.concatenate([[0], np.cumsum(codes != _space)])
            np.logical_or.at(spoken, of[first:last], count[cut[1:]] > count[cut[:-1]])
            first = last
        return total / np.maximum(size, 1)[:, None], size, spoken

    def bounds(self, language: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The highest cross-entropy that is accepted, by language and number of characters."""
        at = np.log(np.clip(size, LENGTHS[0], LENGTHS[-1]))
        limits = self.medians + REACH * self.spread
        return np.array([np.interp(x, np.log(LENGTHS), limits[i]) for i, x in zip(language, at)]) if len(at) else np.zeros(0)

    def calibrate(self, held: list[list[str]]) -> None:
        """Set the bounds from held-out texts of each language."""
        self.medians = np.zeros((len(held), len(LENGTHS)))
        away: list[list[np.ndarray]] = [[] for _ in LENGTHS]
        for i, ts in enumerate(held):
            raw = [t.encode("utf-8", "replace") for t in ts]
            codes, cut = letters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            place = places(cut)
            logs = -self.score(codes, place)[:, i].astype(np.float64)
            for j, size in reversed(list(enumerate(LENGTHS))):
                spans = [logs[a + 1 + k : min(a + 1 + k + size, z)] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()) for k in range(0, max(1, z - a - 1), size)]
                h = np.array([x.mean() for x in spans if 2 * len(x) >= size])
                if not len(h):
                    h = np.array([x.mean() for x in spans if len(x)] or [-self.floor])
                self.medians[i, j] = np.median(h)
                away[j].append(h - self.medians[i, j])
        spread: list[float] = []
        for found in map(np.concatenate, away):  # a length with too few stretches for the quantile takes that of the next shorter
            enough = len(found) * (1 - QUANTILE) >= 1 or not spread
            spread.append(max(LEAST_SPREAD, float(np.quantile(found, QUANTILE))) if enough else spread[-1])
        self.spread = np.array(spread)


def _one_language(codes: np.ndarray, cut: np.ndarray, size: int) -> tuple[list, list]:
    """Of each order: (hashes, log-probabilities, hashes of context, of suffix), and (context hashes, log backoffs)."""
    place = places(cut)
    hashes = [gram_hashes(codes, n, place) for n in range(1, ORDER + 1)]
    inside = np.ones(len(codes), bool)
    inside[cut[:-1]] = False
    grams, contexts = [None] * ORDER, [None] * ORDER
    for n in range(ORDER, 0, -1):
        if n == ORDER:
            keys, example, count = np.unique(hashes[n - 1][inside], return_index=True, return_counts=True)
            example = np.flatnonzero(inside)[example]
        else:  # continuation counts: the different n-grams of the next order that end so
            above = grams[n][1]
            keys, first, count = np.unique(hashes[n - 1][above], return_index=True, return_counts=True)
            example = above[first]
        grams[n - 1] = (keys, example, count)
    out, lower = [], None
    for n in range(1, ORDER + 1):
        keys, example, count = grams[n - 1]
        one, two = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.1, one / max(one + 2 * two, 1)))
        context = hashes[n - 2][example - 1] if n > 1 else np.zeros(len(keys), np.uint64)
        known, which = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(which, count), np.bincount(which)
        back = discount * kinds / total
        suffix = hashes[n - 2][example] if n > 1 else None
        below = np.full(len(keys), 1.0 / size) if n == 1 else lower[1][np.searchsorted(lower[0], suffix)]
        p = (count - discount) / total[which] + back[which] * below
        out.append((keys, np.log(p), context, suffix))
        contexts[n - 1] = (known, np.log(back))
        lower = (keys, p)
    return out, contexts


def train(samples: list[tuple[str, list[str]]]) -> Model | None:
    """A model from texts by language."""
    samples = sorted((lang, [t for t in ts if t]) for lang, ts in samples if any(ts))
    if not samples:
        return None
    parts = {}
    for lang, ts in samples:
        fit = [t for i, t in enumerate(ts) if i % 5] or ts
        raw = [t.encode("utf-8", "replace") for t in fit]
        parts[lang] = letters(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    size = len(np.unique(np.concatenate([c for c, _ in parts.values()]))) + 1
    own = [_one_language(*parts[lang], size) for lang, _ in samples]
    floor = np.log(1.0 / size)
    keys, logs, contexts, backoffs = [], [], [], []
    for n in range(1, ORDER + 1):
        every, first = np.unique(np.concatenate([g[n - 1][0] for g, _ in own]), return_index=True)
        context = np.concatenate([g[n - 1][2] for g, _ in own])[first]
        suffix = np.concatenate([g[n - 1][3] for g, _ in own])[first] if n > 1 else None
        known = np.unique(np.concatenate([c[n - 1][0] for _, c in own]))
        back = np.zeros((len(known), len(own)), np.float32)
        for i, (_, c) in enumerate(own):
            back[np.searchsorted(known, c[n - 1][0]), i] = c[n - 1][1]
        # what a language has not seen backs off to its lower order, which holds every suffix of the union
        table = back[np.searchsorted(known, context)] + (logs[-1][np.searchsorted(keys[-1], suffix)] if n > 1 else np.float32(floor))
        for i, (g, _) in enumerate(own):
            table[np.searchsorted(every, g[n - 1][0]), i] = g[n - 1][1]
        keys.append(every)
        logs.append(table.astype(np.float32))
        contexts.append(known)
        backoffs.append(back)
    model = Model([lang for lang, _ in samples], keys, logs, contexts, backoffs, float(floor))
    model.calibrate([ts[::5] for _, ts in samples])
    return model


def fit(labelled: DataFrame) -> Model | None:
    """Train on a bounded sample of `labelled` (doc_id, text, lang): of each language about as many documents, those with the least hashes."""
    short = (F.octet_length("text") > 0) & (F.octet_length("text") <= MOST_BYTES)
    spoken = labelled.where("lang IS NOT NULL AND octet_length(text) > 0")
    known = spoken.groupBy("lang").agg(F.count_if(short).alias("n"), F.min(F.octet_length("text")).alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not known:
        return None
    each = max(5, SAMPLE_DOCS // len(known))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_000_007))
    wanted = [F.when((F.col("lang") == lang) & (short if n else F.octet_length("text") == least), place < int(min(1.0, 1.5 * each / max(n, 1) + 20 / max(n, 1)) * 1_000_000_007)) for lang, n, least in known]
    rows = spoken.where(F.coalesce(*wanted, F.lit(False))).select("lang", "text", place.alias("place"), "doc_id").collect()
    by: dict[str, list[str]] = {}
    for lang, text, _, _ in sorted(rows, key=lambda r: (r[0], r[2], str(r[3]), r[1])):
        if len(by.setdefault(lang, [])) < each:
            by[lang].append(text)
    return train(list(by.items()))


_PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"


def _predict(shipped):
    def predict(batches):
        model = shipped.value
        for batch in pieces(batches):
            n = batch.num_rows
            if model is None:
                best, score, least, rejected, spoken, names = np.zeros(n, int), np.zeros(n), np.zeros(n), np.ones(n, bool), np.zeros(n, bool), ["und"]
            else:
                h, size, spoken = model.entropies(*texts(batch.column("text")))
                best = h.argmin(axis=1)
                least = h[np.arange(n), best]
                score = np.where(spoken, 1.0 / np.exp(-SHARPNESS * (h - least[:, None])).sum(axis=1), 0.0)
                rejected = ~spoken | (least > model.bounds(best, size))
                names = model.languages
            lang = [names[i] if s else "und" for i, s in zip(best, spoken)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(least), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return predict


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (the best language's share of the likelihoods a character), cross_entropy, rejected of every document of `docs` (doc_id, text)."""
    shared.tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(shipped), _PREDICTED)


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not rejected."""
    shared.tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    predict = _predict(shipped)

    def keep(batches):
        for batch in pieces(batches):
            (found,) = predict(iter([batch]))
            yield batch.filter(pa.array(~found.column("rejected").to_numpy(zero_copy_only=False)))

    return docs.mapInArrow(keep, docs.schema)
