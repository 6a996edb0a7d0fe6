"""Centroid clustering by ball k-means, exact in integers.

Components are scaled to integers, so distances, sums and centroids have no rounding and ties are decided alike on any cluster of machines.
The first `k` centroids are the vectors with the least hash. A round assigns every vector, and then moves each centroid to the mean of its vectors, rounded down.

A cluster is a ball around its centroid that holds all its vectors. Whether another centroid can take any of them follows from exact squared distances:

* neighbours: centroid j concerns ball i only if D(i, j) <= 2 * radius, where the radius after a move is at most the old radius and the length of the move; and only if
  i or j moved since the last assignment, because else it was compared already;
* stable core: a vector nearer to its own centroid than half of the way to the nearest neighbour stays, without any comparison;
* annuli: neighbours sorted by D(i, j) cut the rest of the ball to rings; a vector in ring m, so D(i, m) <= 2 d < D(i, m + 1), is compared exactly with the first m neighbours only.

All vectors begin in ball 0, which makes the first assignment a round like any other. Each round is one pass of the vectors with `k` centroids, written to the
shared folder, and one aggregation of k sums that combines before the shuffle; the driver holds k centroids and their distances, whatever the number of vectors.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones are left out, and so are those with a component of LARGEST or more in size, because a
squared distance would leave 64 bits. With fewer than `k` vectors each is a centroid. Repeated rows are vectors of their own; equal hashes (of equal or null ids) are ordered by the
vectors' components. A null vec_id counts as an empty text in the hash and stays null. Other columns are ignored. A table without vectors gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import release

LARGEST = 1 << 18  # in units of the given components
_STATE = "vec_id long, x array<int>, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id and x (integers, floor(scale * component)) of every vector that takes part."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = (F.size("v") == dimensions) & F.forall("v", lambda x: F.coalesce((x < LARGEST) & (x > -LARGEST), F.lit(False)))  # NaN is above every number
    return given.where(F.coalesce(fit, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * float(scale)).cast("int")).alias("x"))


def distances(centroids: np.ndarray) -> np.ndarray:
    """Squared distances between centroids."""
    return np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], np.int64).reshape(len(centroids), len(centroids))


def neighbours(centroids: np.ndarray, before: np.ndarray, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ball the centroids that can take some of its vectors, nearest first, and their squared distances.

    `before`: the centroids of the last assignment, `radius`: the largest squared distance to them in each ball (-1: no vector).
    """
    between, moved = distances(centroids), ((centroids - before) ** 2).sum(axis=1)
    out = []
    for i in range(len(centroids)):
        if radius[i] < 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        reach = 2 * (math.isqrt(int(radius[i])) + math.isqrt(int(moved[i])) + 2)  # rounded up
        near = [j for j in range(len(centroids)) if j != i and int(between[i, j]) <= reach * reach and (moved[i] or moved[j])]
        near = np.array(sorted(near, key=lambda j: (between[i, j], j)), np.int64)  # noqa: B023
        out.append((near, between[i, near]))
    return out


def assign(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), its squared distance, and how many distances were worked out."""
    own = ((x - centroids[cluster]) ** 2).sum(axis=1)
    best, least, done = cluster.copy(), own.copy(), len(x)
    for i in np.unique(cluster).tolist():
        others, between = near[i]
        rows = np.flatnonzero(cluster == i)
        ring = np.searchsorted(between, 4 * own[rows], "right")  # neighbours with D <= 2 d; none in the stable core
        for m, j in enumerate(others.tolist()):
            rows, ring = rows[ring > m], ring[ring > m]
            if not len(rows):
                break
            d = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
            best[rows[better]], least[rows[better]] = j, d[better]
            done += len(rows)
    return best, least, done


def _round(centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], first: bool):
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, centroids.shape[1])
            cluster = np.zeros(batch.num_rows, np.int64) if first else batch.column("cluster").to_numpy().astype(np.int64)
            best, least, _ = assign(x, cluster, centroids, near)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "x", "cluster", "distance"])
        release()

    return run


def ball_kmeans(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimensions: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector of `vectors` (vec_id, embedding) that takes part; `k` centroids are held by driver and tasks."""
    spark = vectors.sparkSession
    kept = shared.settle(whole_vectors(vectors, dimensions, scale), "vectors")
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = [r.x for r in kept.orderBy(hash_, "x").limit(k).select("x").collect()]  # k rows
    if not start:
        shared.discard(kept)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array(start, np.int64)
    between = ((centroids - centroids[0]) ** 2).sum(axis=1)
    order = np.argsort(between[1:], kind="stable") + 1
    near = [(order, between[order])]  # at first all vectors are in ball 0, whose radius is not known
    state, n = kept, 0
    while True:
        new = shared.settle(state.mapInArrow(_round(centroids, near, n == 0), _STATE), "assigned")
        shared.discard(state)
        state = new
        balls = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.sum("distance").alias("inertia"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]).collect()  # k rows
        if n == rounds:
            break
        n += 1
        before, centroids, radius = centroids, centroids.copy(), np.full(len(centroids), -1, np.int64)
        for ball in balls:
            centroids[ball.cluster] = [ball[f"s{i}"] // ball.n for i in range(dimensions)]
            radius[ball.cluster] = ball.radius
        near = neighbours(centroids, before, radius)
    inertia = sum(b.inertia for b in balls)
    rows = [(b.cluster, b.inertia, inertia, hashlib.sha256(",".join(map(str, centroids[b.cluster].tolist())).encode()).hexdigest()) for b in balls]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _oracle(k: int, rounds: int) -> str:
    nearest = """assigned{n} AS MATERIALIZED (
  SELECT vec_id, v, CAST(arg_min(c, (d, c)) AS INT) AS c, CAST(min(d) AS BIGINT) AS d FROM (
    SELECT v.vec_id, v.row AS v, m.c, sum((x.x - m.x) * (x.x - m.x)) AS d FROM vectors v JOIN parts x ON x.row = v.row JOIN means{n} m ON m.i = x.i GROUP BY v.vec_id, v.row, m.c
  ) GROUP BY vec_id, v
)"""
    moved = """means{m} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(n.x, o.x) AS x FROM means{n} o LEFT JOIN (
    SELECT a.c, p.i, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM assigned{n} a JOIN parts p ON p.row = a.v GROUP BY a.c, p.i
  ) n ON n.c = o.c AND n.i = o.i
)"""
    steps = [nearest.format(n=0)]
    for n in range(rounds):
        steps += [moved.format(n=n, m=n + 1), nearest.format(n=n + 1)]
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, i, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT row, embedding, unnest(range(1, 65)) AS i FROM vectors)
), means0 AS MATERIALIZED (
  SELECT f.c, p.i, p.x FROM (SELECT row, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM vectors QUALIFY c < {k}) f JOIN parts p USING (row)
), {", ".join(steps)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, m.h AS centroid_sha256
FROM assigned{rounds} a JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM means{rounds} GROUP BY c) m ON m.c = a.c
"""


# The query's result in DuckDB's SQL: every vector against every centroid in each round.
ORACLE = _oracle(40, 5)
