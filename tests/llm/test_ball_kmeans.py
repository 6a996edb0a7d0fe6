"""Ball k-means against a plain version that compares every vector with every centroid."""

import hashlib
import math
import random

import numpy as np
import pytest

from trajspark.llm import ball_kmeans as bk

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster string, distance string, n int"


def plain(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    centroids = [x for _, _, x in sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), x, x) for i, x in kept)[:k]]
    d = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for n in range(rounds + 1):
        at = [min((d(x, c), j) for j, c in enumerate(centroids)) for _, x in kept]
        if n < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x), (_, c) in zip(kept, at) if c == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    inertia = [sum(e for e, c in at if c == j) for j in range(len(centroids))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), c, e, inertia[c], sum(inertia), name[c]) for (i, _), (e, c) in zip(kept, at))


def found(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, None, None, None, None) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_against_a_plain_version(spark, spread):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(7, 64))
    rows = [(i, (middles[i % 7] + spread * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(5, rows[5][1]), (5, rows[6][1])]
    df = frame(spark, rows)
    assert found(bk.ball_kmeans(df)) == plain(rows)
    assert found(bk.ball_kmeans(df, k=3, rounds=2)) == plain(rows, 3, 2)


def test_odd_rows(spark):
    rng = random.Random(2)
    v = lambda: [rng.choice([-1.0, 0.0, 0.5]) for _ in range(64)]
    rows = [(1, None), (2, []), (3, v()[:63]), (4, v() + [0.0]), (5, [*v()[:63], None]), (6, [*v()[:63], float("nan")]), (7, [*v()[:63], float("inf")]), (None, v()), (None, v()), *[(i, [0.25] * 64) for i in range(8, 30)], (30, v()), (30, v())]
    df = frame(spark, rows)
    assert found(bk.ball_kmeans(df)) == plain(rows)  # fewer vectors than centroids, most of them equal
    assert found(bk.ball_kmeans(df, k=4)) == plain(rows, 4)
    assert bk.ball_kmeans(frame(spark, [(1, [1e30] * 64), (2, None)])).count() == 0
    assert bk.ball_kmeans(df.where("false")).columns == bk.ball_kmeans(df).columns


def test_few_are_compared():
    """Balls far apart: their cores need no comparison, and no result changes."""
    rng = np.random.default_rng(0)
    middles = rng.integers(-3000, 3000, (20, 64))
    x = np.concatenate([m + rng.integers(-40, 40, (50, 64)) for m in middles])
    cluster = np.repeat(np.arange(20), 50)
    before = middles.astype(np.int64)
    centroids = before + rng.integers(0, 3, before.shape)
    radius = np.array([((x[cluster == i] - before[i]) ** 2).sum(axis=1).max() for i in range(20)])
    near = bk.neighbours(centroids, before, radius)
    best, least, done = bk.assign(x, cluster, centroids, near)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all() and done == len(x)
    # a wrong assignment is mended whatever the balls are
    cluster = rng.integers(0, 20, len(x))
    radius = np.array([((x[cluster == i] - before[i]) ** 2).sum(axis=1).max() for i in range(20)])
    best, least, done = bk.assign(x, cluster, centroids, bk.neighbours(centroids, before, radius))
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
