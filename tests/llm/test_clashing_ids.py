"""Rows without doc_id, and rows of one doc_id with different texts: they link and repeat like any others."""

import re

import pytest

from trajspark.llm import jaccard_join, shared, substring_dedup

WORDS = "the quick brown fox jumps over the lazy dog while seven other animals watch from a quiet hill near the old stone bridge and nobody says a single word about it until the evening comes again with rain and wind from far away".split()
OTHER = [f"w{i}" for i in range(60)]


def rows():
    a, b = " ".join(WORDS), " ".join(OTHER)
    return [(None, a), (None, a + " end"), (6, a + " too"), (6, b), (7, b + " x"), (8, "alone"), (8, "two words"), (8, "two words"), (None, None), (None, "")]


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows):
    """(doc_id, text, shingles, component, links) of every row, links counted between rows."""
    s = [sets(t) for _, t in rows]
    link = [[i != j and bool(s[i]) and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) for j in range(len(rows))] for i in range(len(rows))]
    out = []
    for i, (d, t) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            more = [j for j in range(len(rows)) if link[x][j] and j not in seen]
            seen.update(more)
            todo += more
        out.append((d, len(s[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None), sum(link[i])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dense", [1, 24])
def test_links(spark, dense):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df, dense=dense, block_rows=3).collect()), key=repr)
    assert got == plain(rows())


def test_one_of_each(spark):
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows())], "doc_id long, text string, n int")
    kept = {(r.doc_id, r.text) for r in jaccard_join.one_of_each(df).collect()}
    assert kept == {(6, rows()[2][1]), (6, rows()[3][1]), (8, "alone"), (8, "two words"), (None, None), (None, "")}
    assert jaccard_join.one_of_each(df).count() == len(kept)


def test_substring_dedup(spark):
    long_ = [f"v{i}" for i in range(40)]
    docs = [(1, " ".join(OTHER + WORDS)), (1, " ".join(WORDS[:10] + long_)), (None, " ".join(WORDS + ["x"])), (None, " ".join(long_ + OTHER[:20])), (2, "short"), (1, None)]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == {
        (1, 60 + len(WORDS), len(WORDS), " ".join(OTHER)),
        (1, 50, 40, " ".join(WORDS[:10])),
        (None, len(WORDS) + 1, len(WORDS), "x"),
        (None, 60, 40, " ".join(OTHER[:20])),
        (2, 1, 0, None),
        (1, 0, 0, None),
    }


def test_keys_tell_rows_apart(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (None, None), (None, ""), (2, "a"), (1, "")], "doc_id long, text string")
    assert shared.keyed(df).select(shared.KEY).distinct().count() == 7
