"""Spelling variants by a symmetric-delete join: words one edit apart, the form each is a variant of, and the root of its forms.

Words are counted with SQL functions. Then each word that is frequent enough emits a key for itself and one for each single deletion, and
words meet on equal keys; two words one edit apart share one of three kinds of them:

* a replaced code point: both give the same deletion at the same place. The words of one (deletion, place) differ in that place alone, so they are all near one
  another, and there are at most as many as letters. They are never paired: counts and the two best words say for each what the others are;
* a deleted or inserted one: a deletion of the longer word is the shorter word itself. A word's equal deletions (at the places of a run of one letter) count once.

Keys are hashes (a polynomial modulo two primes of 31 bits, which a deletion changes by a few operations however long the word is, and the length), so a word
of n letters emits n short rows. The forms found are held against the words themselves: common ends must leave exactly one edit. Roots are
found by following forms twice as far in each round; forms at least double n, so chains are short.

Defined cases: a null text has no words. A null doc_id stands as an empty string before the colon. Repeated rows
count again. Very long words are treated like any others. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import release

# What a run is, and which letters are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY = 97

_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525)
_SALT = 0x5851F42D4C957F2D >> 24  # for the length
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())


def words(docs: DataFrame, least_length: int = 5, least_times: int = 3) -> DataFrame:
    """word, n: the runs of all texts of `docs` (doc_id, text), some with one letter left out, that are long and frequent enough."""
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0)))  # a longest run, since shorter ones can't get long enough
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).select("id", run.alias("run"))
    runs = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= least_length) & (F.col("n") >= least_times))


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < len(out):
        more = min(done, len(out) - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, p)) % np.uint64(p)
        done += more
    return out


def keys(text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The key of each word, then for each code point of all words: the word's number, its place, the code point, and the key of the word without it."""
    codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(x) for x in text], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    number = np.repeat(np.arange(len(text)), size)
    place = np.arange(len(codes)) - first[number]
    own, less = np.zeros(len(text), np.int64), np.zeros(len(codes), np.int64)
    for p, base in zip(_PRIMES, _BASES):
        times = lambda a, b: (a.astype(np.uint64) * b % np.uint64(p)).astype(np.int64)  # noqa: B023, E731
        term = times(codes + 1, _powers(base, int(size.max(initial=1)), p)[place])
        upto = np.concatenate([[0], np.cumsum(term)])
        whole = (upto[first[1:]] - upto[first[:-1]]) % p
        before = (upto[:-1] - upto[first[number]]) % p
        without = (before + times((whole[number] - before - term) % p, np.uint64(pow(base, -1, p)))) % p
        own, less = own << 31 | whole, less << 31 | without
    salt = size * _SALT
    return own ^ salt, number, place, codes, less ^ (salt[number] - _SALT)


def _emitted(batches, most: int = 1 << 16):
    """For each word the key of itself (place -1) and of each deletion; `last` marks the last of equal deletions."""
    for batch in batches:
        text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        size, start = np.cumsum([len(x) for x in text]), 0
        while start < len(text):
            end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most, "right")))
            own, number, place, codes, less = keys(text[start:end])
            last = np.ones(len(codes), bool)
            last[:-1] = (number[1:] != number[:-1]) | (codes[1:] != codes[:-1])
            times, none = n[start:end], np.full(len(own), -1)
            columns = ((own, less), (none, place), (none, codes), (none == -1, last), (own, own[number]), (times, times[number]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(columns, _KINDS)], names=["key", "place", "code", "last", "id", "n"])
            start = end
    release()


def one_edit(a: str, b: str) -> Column:
    """Whether two string columns, not equal, differ by exactly one inserted, deleted or replaced code point: what follows their common start and that one has to be equal."""
    same = F.expr(  # how many code points the common start has, by halving
        f"""aggregate(sequence(0, cast(log2(length({a}) + 1) as int) + 1), struct(0 AS lo, least(length({a}), length({b})) AS hi), (s, i) -> CASE WHEN s.lo = s.hi THEN s
        WHEN left({a}, (s.lo + s.hi + 1) div 2) = left({b}, (s.lo + s.hi + 1) div 2) THEN struct(cast((s.lo + s.hi + 1) div 2 as int) AS lo, s.hi AS hi)
        ELSE struct(s.lo AS lo, cast((s.lo + s.hi + 1) div 2 - 1 as int) AS hi) END, s -> s.lo)"""
    )
    longer = F.length(a) - F.length(b)
    rest = lambda x, skip: F.substring(F.col(x), same + 1 + F.when(skip, 1).otherwise(0), F.length(x))
    return (F.abs(longer) <= 1) & (rest(a, longer >= 0) == rest(b, longer <= 0))


def spelling_variants(docs: DataFrame, least_length: int = 5, least_times: int = 3, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `docs` (doc_id, text) with `least_length` code points and `least_times` occurrences at least.

    A form occurs at least `ratio` times as often as its variant.
    """
    shared.tune(docs.sparkSession)
    counted = shared.settle(words(docs, least_length, least_times), "words")
    emitted = shared.settle(counted.mapInArrow(_emitted, "key long, place int, code int, last boolean, id long, n long"), "emitted")
    ids = shared.settle(emitted.where("place < 0").select("key", "n"), "ids")

    # replaced: the words of a (deletion, place), at most one for each letter; best first, ties to the smallest letter
    slots = emitted.where("place >= 0").groupBy("key", "place").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("code")).alias("code"), "id")), asc=False).alias("w")).where("size(w) > 1")
    replaced = slots.select("w", F.posexplode("w").alias("i", "own")).select(F.col("own.id").alias("id"), (F.size("w") - 1).cast("long").alias("n_near"), F.expr("w[if(i = 0, 1, 0)]").alias("o"))
    replaced = replaced.select("id", "n_near", F.col("o.n").alias("n"), F.col("o.id").alias("other"))
    # deleted and inserted: a deletion that is a word
    longer = shared.may_contain(emitted.where("place >= 0 AND last").select("key", "id", "n"), "key", ids)
    both = longer.join(ids.select("key", F.col("n").alias("key_n")), "key")
    ends = F.explode(F.array(F.struct("id", F.col("key_n").alias("n"), F.col("key").alias("other")), F.struct(F.col("key").alias("id"), "n", F.col("id").alias("other"))))
    near = replaced.unionByName(both.select(ends.alias("e")).select("e.id", F.lit(1).cast("long").alias("n_near"), "e.n", "e.other"))
    near = near.groupBy("id", "n").agg(F.sum("n_near").alias("n_near"), F.collect_set("other").alias("others")).groupBy("id")
    near = shared.settle(near.agg(F.sum("n_near").alias("n_near"), F.max(F.struct("n", "others")).alias("top")).select("id", "n_near", F.col("top.n").alias("top_n"), F.col("top.others").alias("others")), "near")
    shared.discard(ids)

    text = shared.settle(emitted.sparkSession.read.parquet(counted.settled).mapInArrow(_named, "id long, word string, n long"), "text")
    shared.discard(counted, emitted)
    text_of = lambda key, name: text.select(F.col("id").alias(key), F.col("word").alias(name))
    asked = text.join(near, "id").where(F.col("top_n") >= ratio * F.col("n")).select("id", "word", "top_n", F.explode("others").alias("form_id"))
    forms = shared.matched(asked, "form_id", text_of("form_id", "form")).where(one_edit("word", "form")).groupBy("id").agg(F.min(F.struct("form", "form_id")).alias("f"), F.first("top_n").alias("form_n"))
    forms = shared.settle(forms.select("id", "f.form", "f.form_id", "form_n"), "forms")

    roots = shared.settle(forms.select("id", F.col("form_id").alias("root_id")), "roots")
    while True:
        step = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        on = shared.settle(shared.matched(roots, "root_id", step, "left").select("id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")), "roots")
        shared.discard(roots)
        roots = on
        if roots.where("moved").isEmpty():
            break
    known = forms.drop("form_id").join(shared.matched(roots.drop("moved"), "root_id", text_of("root_id", "root")).select("id", "root"), "id")
    out = text.join(near.select("id", "n_near"), "id", "left").join(known, "id", "left")
    out = shared.settle(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "variants")
    shared.discard(text, near, forms, roots)
    return out


def _named(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(keys(batch.column("word").to_pylist())[0]), batch.column("word"), batch.column("n")], names=["id", "word", "n"])


# The query's result in DuckDB's SQL: CRC-32 byte by byte from its table, deletions as strings, forms followed one by one.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), runs AS (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs), crc
), cut AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n AS part FROM hashed
), words AS MATERIALIZED (
  SELECT word, n FROM (SELECT word, CAST(sum(part) AS BIGINT) AS n FROM cut GROUP BY word) WHERE length(word) >= 5 AND n >= 3
), less AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.key = b.key AND a.p = b.p AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.key
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.key
), best AS (
  SELECT w.word, w.n, count(near.other) AS n_near, first(near.other ORDER BY near.n DESC, near.other) AS form, max(near.n) AS form_n FROM words w LEFT JOIN near USING (word) GROUP BY w.word, w.n
), forms AS MATERIALIZED (
  SELECT word, n, n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM best
), chain AS (
  SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) JOIN forms g ON g.word = c.at WHERE g.form IS NULL
"""
