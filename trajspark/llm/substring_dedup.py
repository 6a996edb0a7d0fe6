"""Substring dedup by seed and extend: remove words inside windows that occur elsewhere too.

A window is `window` consecutive words of one document. Every word covered by a window whose words also start
anywhere else, in the same document or another, is removed.

* Seeds: winnowing keeps, of each window, the run of `seed` words with the least hash. Equal windows
  keep equal seeds, so a window can only recur if its seed does. Documents join on the seeds that
  occur more than once.
* Extension: around such a seed every window that has kept it is extended to its full length in both
  directions, as one hash of its words. All occurrences of a seed are compared at once by grouping on
  that hash, so a passage in many thousand documents costs a row for each, not one for each two. Each recurring window gets a partner: the least document
  that has it too, or the greatest where that is the document itself.
* Matches grow on from window to window as long as the partner's window moves along with them (the same partner on the same diagonal), both ways, until one of them ends or differs. What
  comes out are the repeats that can't be extended: `repeats` lists start, number of words, partner and place there. All are `window` words long at least.
* What recurring windows cover goes.

Documents with equal word sequences are one class from the start: if they have a window at all, every word goes.

Defined cases: null counts as empty, gives no words and the hash of an empty text. Texts shorter than a
window lose nothing. Repeated rows repeat each other's windows. Rows are told apart by a hash of doc_id and text, so
those without doc_id, or with the doc_id of another text, take part like any others (a partner is named by its doc_id). Other columns are ignored. An empty
table gives no rows. Window hashes have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import Words, combine, joined, pieces

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    length = 1
    while 2 * length <= width:
        x = f(x[:-length], x[length:])
        length *= 2
    rest = width - length
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def _windows(w: Words, hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows, the hash of each one's seed, and the seeds' hashes by position."""
    grams = combine(hashes, seed)
    least = _slide(grams, window - seed + 1, np.minimum)
    inside = np.zeros(len(hashes) + 1, np.int64)
    full = np.maximum(w.counts - window + 1, 0)
    np.add.at(inside, w.first[:-1], full > 0)
    np.add.at(inside, w.first[:-1] + full, -1 * (full > 0))
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return starts, least[starts], grams


def _seeds(batches, window: int, seed: int):
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        h = w.hashes()
        starts, least, grams = _windows(w, h, window, seed)
        reach = window - seed + 1
        seen = np.zeros(len(h) + reach, np.uint64)  # entry s + reach - 1: the seed of window s
        seen[starts + reach - 1] = least
        best = _slide(seen, reach, np.maximum)[: len(grams)]  # over the windows that hold a position
        chosen = np.flatnonzero((best == grams[: len(best)]) & (best > 0))
        document = np.searchsorted(w.first, chosen, "right") - 1
        cut = np.searchsorted(document, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column(shared.KEY),
                pa.array(w.counts.astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in joined(w)], pa.string()),
                pa.ListArray.from_arrays(cut.astype(np.int32), grams[chosen].astype(np.int64)),
            ],
            names=["doc_id", shared.KEY, "n_words", "whole", "seeds"],
        )


def _extended(batches, window: int, seed: int):
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        h = w.hashes()
        starts, least, _ = _windows(w, h, window, seed)
        hashes = combine(h, window)
        document = np.searchsorted(w.first, starts, "right") - 1
        cut = np.searchsorted(document, np.arange(batch.num_rows + 1))
        at, found = [], []
        for i, seeds in enumerate(batch.column("seeds")):
            own = slice(cut[i], cut[i + 1])
            hit = np.isin(least[own], seeds.values.to_numpy().astype(np.uint64))
            at.append(starts[own][hit] - w.first[i])
            found.append(hashes[starts[own][hit]])
        ends = np.cumsum([0, *map(len, at)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"),
                batch.column("doc"),
                pa.ListArray.from_arrays(ends, np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int32)),
                pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.int64)),
            ],
            names=["node", "doc", "starts", "hashes"],
        )


def extended(document: np.ndarray, start: np.ndarray, partner: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Recurring windows grown to maximal repeats: document, start, words and place at the partner of each, document by document, and which of the given windows is its first."""
    order = np.lexsort((start, start - at, partner, document))
    document, start, partner, at = document[order], start[order], partner[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (document[1:] != document[:-1]) | (partner[1:] != partner[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = (np.append(first[1:], len(order)) - 1)[: len(first)]
    by_start = np.lexsort((start[first], document[first]))
    first, last = first[by_start], last[by_start]
    return document[first], start[first], start[last] - start[first] + window, at[first], order[first]


_REPEATS = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("partner", pa.int64()), ("at", pa.int32())]))


def _kept(batches, window: int):
    for batch in pieces(batches):
        w = Words(batch.column("text"))
        found = batch.column("found")
        size, flat = found.value_lengths().to_numpy(), found.flatten()
        start, partner, there = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        change = np.zeros(len(w.starts) + 1, np.int64)
        at = np.repeat(w.first[:-1], size) + start
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        document, begin, length, place, which = extended(np.repeat(np.arange(batch.num_rows), size), start, partner, there, window)
        repeats = (pa.array(begin, pa.int32()), pa.array(length, pa.int32()), flat.field(2).take(pa.array(which)), pa.array(place, pa.int32()))
        lists = pa.ListArray.from_arrays(np.searchsorted(document, np.arange(batch.num_rows + 1)).astype(np.int32), pa.StructArray.from_arrays(repeats, fields=list(_REPEATS.value_type)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(np.diff(total[w.first]).astype(np.int64)), pa.array([x.decode("utf-8", "replace") for x in joined(w, ~gone)], pa.string()), lists],
            names=["node", "n_removed", "kept", "repeats"],
        )


def substring_dedup(docs: DataFrame, window: int = 35, seed: int = 16) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text; null if nothing was removed), repeats (null if none, or if the whole document recurs) and kept_sha256 of every document of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    shared.tune(spark)
    docs = shared.keyed(docs)
    found = shared.settle(docs.mapInArrow(lambda b: _seeds(b, window, seed), f"doc_id long, {shared.KEY} long, n_words long, whole string, seeds array<long>"), "seeds")
    classes = found.groupBy("whole").agg(F.min(shared.KEY).alias("node"), F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.min_by("seeds", shared.KEY).alias("seeds"))
    classes, made = shared.settle(classes, "classes"), []

    planted = classes.select("node", "doc", F.explode("seeds").alias("seed"))
    recurring = shared.recurring(planted, "seed", "seed-counts", made=made).groupBy("node").agg(F.first("doc").alias("doc"), F.collect_set("seed").alias("seeds"))
    recurring = shared.settle(recurring, "recurring")
    docs = docs.select(F.col(shared.KEY).alias("node"), "text")
    text = shared.may_contain(docs, "node", recurring)
    windows = text.join(recurring, "node").select("node", "doc", "text", "seeds").mapInArrow(lambda b: _extended(b, window, seed), "node long, doc long, starts array<int>, hashes array<long>")
    made.append(windows := shared.settle(windows, "windows"))
    windows = windows.select("node", "doc", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("node", "doc", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    single = classes.where("copies = 1").select("node")
    place = F.struct(F.col("doc").isNull().alias("nameless"), "doc", "node", "start")
    mine = F.col("least.node") == F.col("node")
    other = lambda c: F.when(mine, F.col(f"most.{c}")).otherwise(F.col(f"least.{c}"))
    window_of = F.struct("start", other("node").alias("partner"), other("doc").alias("doc"), other("start").alias("at"))
    repeats = shared.recurring(windows, "hash", "window-counts", F.min(place).alias("least"), F.max(place).alias("most"), made=made).groupBy("node").agg(F.collect_list(window_of).alias("found")).join(single, "node")
    repeats = shared.settle(repeats, "repeats")
    shared.discard(recurring, *made)
    lists = "array<struct<start:int,n_words:int,partner:bigint,at:int>>"
    cut = shared.may_contain(docs, "node", repeats).join(repeats, "node").select("node", "text", "found").mapInArrow(lambda b: _kept(b, window), f"node long, n_removed long, kept string, repeats {lists}")
    cut = cut.select("node", "n_removed", "kept", "repeats", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

    known = classes.select("whole", "node", "copies").join(cut, "node", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return found.select("doc_id", "n_words", "whole").join(known, "whole").select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(all_gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
        "repeats",
        F.when(all_gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


# The query's result in DuckDB's SQL: every window of every document.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS k FROM windows JOIN again USING (h), range(35) r(j)
), kept AS (
  SELECT x.doc_id, array_to_string(list(x.word ORDER BY x.k), ' ') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k GROUP BY x.doc_id
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
