"""Spelling variants against a plain version, on words that crowd together and on odd rows."""

import collections
import random
import re
import zlib

import pyarrow as pa

from trajspark.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string, word string, n int, id string, key long, form string"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = collections.Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m.group().lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            p = h % len(r)
            n[r[:p] + r[p + 1 :] if h % 97 == 0 else r] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y), default=None) for w, x in near.items()}
    form = {w: x if x and n[x] >= 2 * n[w] else None for w, x in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_against_a_plain_version(spark):
    rng = random.Random(5)
    letters = "abéA"  # few letters: most words are near many others, with equal deletions and equal counts
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) + rng.choice(["", ".", "1"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    df = spark.createDataFrame([(*r, None, None, "x", None, None) for r in rows], SCHEMA).repartition(5)
    want = plain(rows)
    assert found(sv.spelling_variants(df)) == want
    assert max(x[3] for x in want.values()) > 10 and sum(x[0] is not None for x in want.values()) > 20 and any(x[1] != (x[0] or w) for w, x in want.items())


def test_odd_rows(spark):
    rng = random.Random(1)
    long_ = "".join(rng.choice("acgt") for _ in range(20_000))
    other = long_[:9_000] + "z" + long_[9_001:]
    texts = [None, "", "12 !!", "x" * 50_000 + " ", "Straße STRASSE straße", "maximal×÷maximal", long_, other, "color colour colour1colour", " ".join(["colour"] * 9 + ["color"] * 4 + ["colours"] * 3)]
    rows = [(i, t) for i, t in enumerate(texts)] * 3 + [(6, long_)] * 6 + [(None, "colour"), (None, None)]
    df = spark.createDataFrame([(*r, None, None, "x", None, None) for r in rows], SCHEMA)
    got = found(sv.spelling_variants(df))
    assert got == plain(rows)
    assert got[other][:2] == (long_, long_) and got["color"][0] == "colour"
    assert sv.spelling_variants(df.where("false")).count() == 0


def test_a_letter_that_most_words_vary(spark):
    """90 words that differ at one place are near one another, counted without pairs."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    rows = [(1, " ".join(f"ab{c}de" for c in letters for _ in range(3 + (c == "k"))))]
    got = found(sv.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows)


def test_keys_of_deletions():
    words = ["abca", "bca", "aaab", "é" * 300, "x"]
    own, number, place, _, less = sv.keys(words)
    for i, at, key in zip(number.tolist(), place.tolist(), less.tolist()):
        w = words[i][:at] + words[i][at + 1 :]
        assert not w or sv.keys([w])[0][0] == key
    assert pa.array(own).type == pa.int64() and len(set(own.tolist())) == len(words)


def test_edits_of_columns(spark):
    pairs = [("abcde", "abde"), ("abde", "abcde"), ("abcde", "abxde"), ("abcde", "abxdf"), ("abcde", "bacde"), ("abcde", "abcdexy"), ("éa" * 40, "éa" * 39 + "é"), ("aab", "ab"), ("ab", "ba")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sv.one_edit("a", "b").alias("ok")).collect()
    assert [r.ok for r in rows] == [one_edit(a, b) for a, b in pairs]
