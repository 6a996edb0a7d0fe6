"""Approximate nearest neighbours by inner product, on balanced posting lists.

* Index: centroids come from a bounded, hash-chosen sample of the vectors (two levels of k-means on the driver: groups, and lists within
  them; groups and lists that hold too much of the sample are split in two). There is a list for each `list_size` vectors, up to MOST_LISTS.
  Inner products become distances by one more component that gives every vector the norm of the longest. Every vector goes to the list of its
  nearest centroid, and a boundary vector also to up to `copies` - 1 others: those whose centroid is at most `closure` times as far. `closure` follows from the sample: the
  largest, up to MOST_CLOSURE, at which a vector has `spread` homes on average.
* Search: a query walks the centroids' neighbour graph in memory, best first, and takes the lists whose
  centroids are at most `ratio` times as far as the nearest. The graph is connected, its centroids are distinct, and each has links in several
  directions, so groups of equal or close vectors are reached.
* Lists that lie together form a bundle of about `bundle` vectors. A query is sent once to each bundle that holds a list of its own, with the
  list numbers, and meets the vectors of those lists alone; the bundle answers with its own best rows, and a query's best of all bundles
  win. A bundle with more vectors is cut to shards by a hash, and its queries to blocks, so a task meets a bounded number of either, however large a
  list or cluster is.

How far a query looks (`ratio`) is found at build time: HELD_OUT of the queries, hash-chosen and kept out of the k-means sample, are also
answered by brute force, and `ratio` is the least on a fixed scale with which the lists of the worse-off half of them hold `recall` of its true neighbours. Vectors with
clusters need few lists; without any, distances hardly differ and most lists are taken, at worst all, which is a full scan.

Scores are sums of products in double precision, in the order of the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of several dimensions are searched apart, each among its own. Of
rows with equal ids the one with the greatest vector (component by component) counts. Ties go to the smaller vec_id. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SAMPLE = 20_000  # vectors of the sample, or 4 for each list if that is more
SAMPLE_BYTES = 128 << 20
MOST_LISTS = 1 << 16
DEGREE = 16
HELD_OUT = 128
MOST_CLOSURE = 1.15
RATIOS = tuple(1 + 0.02 * 1.25**i for i in range(24))  # 1.02 to 4.4


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centroids of about equal lists."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        order = np.argsort(own, kind="stable")
        some, first = np.unique(own[order], return_index=True)
        c[some] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    own, out = nearest(x, c), []
    c, own = c[np.unique(own)], np.unique(own, return_inverse=True)[1]  # equal centroids leave all but one of them empty
    most = max(8, 4 * len(x) // len(c))
    todo = [(x[own == i], c[i]) for i in range(len(c))]
    while todo:
        part, centre = todo.pop()
        if len(part) <= most or len(out) + len(todo) >= 2 * k or not (spread := part.var(axis=0)).any():
            out.append(centre)
            continue
        side = part[:, spread.argmax()] > np.median(part[:, spread.argmax()])
        if not 0 < side.sum() < len(side):
            out.append(centre)
        else:
            todo += [(part[s], part[s].mean(axis=0)) for s in (side, ~side)]
    return np.unique(np.array(out), axis=0)


def two_levels(x: np.ndarray, k: int) -> np.ndarray:
    """About k distinct centroids; those of one group stand together."""
    if k <= 64:
        return kmeans(x, k)
    groups = kmeans(x, int(np.sqrt(k)))
    own = nearest(x, groups)
    parts = [x[own == g] for g in range(len(groups))]
    every = np.concatenate([kmeans(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])
    _, first = np.unique(every, axis=0, return_index=True)
    return every[np.sort(first)]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 22) // len(c))
    return np.concatenate([distances(x[i : i + step], c).argmin(axis=1) for i in range(0, len(x), step)])


def linked(c: np.ndarray) -> list[np.ndarray]:
    """A connected graph of neighbours. Half of a node's DEGREE are its nearest, the others the nearest in other directions: none of them is
    nearer to one already taken than to the node, so a tight group has links out of it. Parts that are still apart are linked where they are nearest."""
    n = len(c)
    links: list[set[int]] = [set() for _ in range(n)]
    step = max(1, (1 << 22) // max(n, 1))
    for a in range(0, n, step):
        between = distances(c[a : a + step], c)
        near = np.argpartition(between, min(n - 1, 8 * DEGREE), axis=1)[:, : 8 * DEGREE + 1]
        for i, row in enumerate(between, start=a):
            order = near[i - a][np.argsort(row[near[i - a]], kind="stable")]
            order = order[order != i]
            links[i].update(order[: DEGREE // 2].tolist())
            among = distances(c[order], c[order])
            here = np.arange(len(order))
            for _ in range(DEGREE // 2):
                if not len(here):
                    break
                j = here[0]
                links[i].add(int(order[j]))
                here = here[1:]
                here = here[among[j][here] >= row[order[here]]]
    for i, r in enumerate(list(map(tuple, links))):
        for j in r:
            links[j].add(i)
    reached = np.zeros(n, bool)
    todo = [0] if n else []
    while todo:
        reached[todo] = True
        todo = sorted({j for i in todo for j in links[i] if not reached[j]})
        if not todo and not reached.all():
            inside, outside = np.flatnonzero(reached), np.flatnonzero(~reached)
            own = nearest(c[outside], c[inside])
            at = int(((c[outside] - c[inside[own]]) ** 2).sum(axis=1).argmin())
            a, b = int(inside[own[at]]), int(outside[at])
            links[a].add(b)
            links[b].add(a)
            todo = [b]
    return [np.array(sorted(r), int) for r in links]


class Centroids:
    def __init__(self, c: np.ndarray, longest: float):
        self.c, self.longest = c, longest
        self.links = linked(c)
        self.entry = int(distances(c.mean(axis=0)[None, :], c).argmin())

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Vectors with the component that gives them the longest one's norm."""
        return np.hstack([v, np.sqrt(np.maximum(self.longest**2 - (v * v).sum(axis=1), 0))[:, None]])

    def homes(self, v: np.ndarray, copies: int, closure: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): where vectors go, a boundary vector to several lists."""
        rows, lists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step, copies = max(1, (1 << 22) // len(self.c)), min(copies, len(self.c))
        for a in range(0, len(v), step):
            d = np.sqrt(distances(self.lifted(v[a : a + step]), self.c))
            some = np.argpartition(d, copies - 1, axis=1)[:, :copies]
            far = np.take_along_axis(d, some, axis=1)
            row, column = np.nonzero(far <= closure * far.min(axis=1)[:, None])
            rows.append(row + a)
            lists.append(some[row, column])
        return np.concatenate(rows), np.concatenate(lists)

    def closure(self, v: np.ndarray, copies: int, spread: float) -> float:
        """How much farther than the nearest a further home of these vectors can be for `spread` homes on average."""
        copies = min(copies, len(self.c))
        d = np.sqrt(np.partition(distances(self.lifted(v), self.c), copies - 1, axis=1)[:, :copies])
        ratios = np.sort((np.sort(d, axis=1)[:, 1:] / np.maximum(d.min(axis=1), 1e-12)[:, None]).ravel())
        at = int((spread - 1) * len(v))
        return min(MOST_CLOSURE, float(ratios[at])) if at < len(ratios) else MOST_CLOSURE

    def search(self, q: np.ndarray, ratio: float, sizes: np.ndarray, least: int, width: int = 32) -> np.ndarray:
        """The lists of one query, nearest first: those within `ratio` of the nearest, and more while they hold fewer than `least` rows. `width`: as many as are looked at first."""
        while True:
            found = [(d, i) for d, i in self._walk(q, width) if sizes[i]]
            far, at = np.array([d for d, _ in found]), np.array([i for _, i in found], np.int64)
            held = np.cumsum(sizes[at])
            reach = ratio * ratio * max(far[0], 1e-12) if len(far) else 0
            if width >= len(self.c) or len(far) and held[-1] >= least and far[-1] > reach:
                break
            width *= 4
        return at[: max(np.searchsorted(far, reach, "right"), np.searchsorted(held, least) + 1)]

    def _walk(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        """The `width` nearest centroids that the walk finds, with their squared distances."""
        size = np.sqrt((q * q).sum())
        q = np.append(q * (self.longest / size), 0.0)
        far = lambda at: ((self.c[at] - q) ** 2).sum(axis=-1)
        if width >= len(self.c):  # the graph is connected, so the walk would find all
            d = far(np.arange(len(self.c)))
            return [(float(d[i]), int(i)) for i in np.argsort(d, kind="stable")]
        seen = {self.entry}
        first = float(far(self.entry))
        todo, best = [(first, self.entry)], [(-first, self.entry)]
        while todo:
            d, at = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [int(i) for i in self.links[at] if i not in seen]
            seen.update(new)
            for x, i in zip(far(new).tolist() if new else [], new):
                if len(best) < width or x < -best[0][0]:
                    heapq.heappush(todo, (x, i))
                    heapq.heappush(best, (-x, i))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and v (doubles) of the vectors that take part, one row an id."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
    )
    return v.groupBy("vec_id").agg(F.max("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of q (one, or one for each row of v) added up component by component, so equal vectors get equal scores."""
    total = np.zeros(v.shape[:-1])
    for i in range(v.shape[-1]):
        total += q[..., i, None] * v[..., i] if q.ndim > 1 else q[i] * v[..., i]
    return total


def top(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, seen: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of v, score) of each query's k best rows; `seen` says which rows a query meets, `own` are the queries' ids."""
    rough = q @ v.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    if seen is not None:
        rough[~seen] = -np.inf
    wide = min(len(ids), k + 12)
    slack = 1e-9 * np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1).max())
    some = np.argpartition(-rough, wide - 1, axis=1)[:, :wide]
    near = np.take_along_axis(rough, some, axis=1)
    least = -np.partition(-near, min(k, wide) - 1, axis=1)[:, min(k, wide) - 1]
    score = np.where(near > -np.inf, exact_scores(q, v[some]), -np.inf)
    order = np.lexsort((ids[some], -score))[:, :k]
    rows, scores = np.take_along_axis(some, order, axis=1), np.take_along_axis(score, order, axis=1)
    many = np.flatnonzero((near.min(axis=1) >= least - slack) & (near.min(axis=1) > -np.inf)) if wide < len(ids) else []
    for i in many:  # more rows than `wide` tie for the last place
        tied = np.flatnonzero(rough[i] >= least[i] - slack[i])
        s = exact_scores(q[i], v[tied])
        best = np.lexsort((ids[tied], -s))[:k]
        rows[i], scores[i] = tied[best], s[best]
    query, place = np.nonzero(scores > -np.inf)
    return query, rows[query, place], scores[query, place]


def _answers(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})


def _meet(k: int, copies: int, cells: int = 1 << 20):
    def meet(queries: pa.Table, listed: pa.Table) -> pa.Table:
        if not queries.num_rows or not listed.num_rows:
            return _answers([], [], [])
        listed = listed.sort_by("list")
        home, ids, v = listed.column("list").to_numpy(), listed.column("vec_id").to_numpy(), _matrix(listed.column("v"))
        own, q = queries.column("query_id").to_numpy(), _matrix(queries.column("v"))
        wanted = queries.column("lists").combine_chunks()
        out, size = [], max(1, cells // len(ids))
        for a in range(0, len(own), size):
            some = wanted.slice(a, size)
            seen = np.zeros((len(some), len(ids) + 1), np.int8)  # a list is a stretch of rows
            row, lists = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy()), some.flatten().to_numpy()
            np.add.at(seen, (row, np.searchsorted(home, lists, "left")), 1)
            np.add.at(seen, (row, np.searchsorted(home, lists, "right")), -1)
            seen = np.cumsum(seen[:, :-1], axis=1, dtype=np.int8) > 0
            query, at, score = top(q[a : a + size], own[a : a + size], v, ids, seen, k * copies if len(np.unique(ids)) < len(ids) else k)
            new = np.append(True, (query[1:] != query[:-1]) | (ids[at][1:] != ids[at][:-1]))[: len(query)]  # copies of a vector stand together
            query, at, score = query[new], at[new], score[new]
            best = np.arange(len(query)) - np.searchsorted(query, query) < k
            out.append(_answers(own[a : a + size][query[best]], ids[at[best]], score[best]))
        return pa.concat_tables(out)

    return meet


def best_rows(met: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query; a vector met in several lists counts once. Each task keeps a query's best before they are shuffled."""
    found = met.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("b"))
    rows = found.select("query_id", F.posexplode("b").alias("place", "r"))
    return rows.select("query_id", (F.col("place") + 1).alias("rank"), "r.vec_id", (-F.col("r.s")).alias("score"))


def _brute(rows: DataFrame, tests: list, k: int) -> list:
    """(test, vector) of the true neighbours of a few vectors."""
    ids, q = np.array([t[0] for t in tests]), np.array([t[1] for t in tests])

    def best(batches):
        for batch in batches:
            query, at, score = top(q, ids, v := _matrix(batch.column("v")), batch.column("vec_id").to_numpy(), None, k)
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), batch.column("vec_id").take(pa.array(at)), pa.array(score), pa.array(list(v[at]), pa.list_(pa.float64()))], names=["test", "vec_id", "score", "v"])

    rank = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("score"), "vec_id"))
    found = rows.mapInArrow(best, "test int, vec_id long, score double, v array<double>")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("test", "v").collect()  # HELD_OUT * k rows at most


def calibrated(index: Centroids, tests: list, truth: list, homes: list[set], recall: float, sizes: np.ndarray, least: int) -> float:
    """The least ratio with which the worse-off half of the held-out queries finds `recall` of its true neighbours; infinite if none does."""
    if not truth:
        return RATIOS[-1]
    of = np.array([t[0] for t in truth])
    low, high = 0, len(RATIOS)
    while low < high:
        at = (low + high) // 2
        lists = [set(index.search(np.array(t[1]), RATIOS[at], sizes, least).tolist()) for t in tests]
        found = np.array([not lists[i].isdisjoint(h) for i, h in zip(of.tolist(), homes)])
        shares = np.sort(np.bincount(of, found)[np.unique(of)] / np.bincount(of)[np.unique(of)])
        low, high = (low, at) if shares[: -(-len(shares) // 2)].mean() >= recall else (at + 1, high)
    return RATIOS[low] if low < len(RATIOS) else np.inf


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, list_size: int = 256, copies: int = 4, spread: float = 1.5, bundle: int = 8192, block: int = 4096, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector of `queries` its k best in `vectors` (both vec_id, embedding), itself excluded; see above for the rest."""
    spark = vectors.sparkSession
    shared.tune(spark)
    rows = shared.settle(usable(vectors), "vectors")
    asked = shared.settle(usable(queries).withColumnRenamed("vec_id", "query_id"), "asked")
    dims = [r[0] for r in asked.select("dim").distinct().join(rows.select("dim").distinct(), "dim").orderBy("dim").collect()]
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dims:  # as a rule one
        own = F.col("dim") == dim
        found = _searched(rows.where(own).drop("dim"), asked.where(own).drop("dim"), dim, k, list_size, copies, spread, bundle, block, recall)
        out = found if len(dims) == 1 else out.union(found)
    return out


def _searched(rows: DataFrame, asked: DataFrame, dim: int, k: int, list_size: int, copies: int, spread: float, bundle: int, block: int, recall: float) -> DataFrame:
    spark = rows.sparkSession
    norm = F.sqrt(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))
    count, longest = rows.agg(F.count("*"), F.max(norm)).first()
    lists = max(1, min(MOST_LISTS, count // list_size))
    size = min(max(SAMPLE, 4 * lists), SAMPLE_BYTES // (8 * dim))
    chance = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_003))
    tests = [tuple(r) for r in asked.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(HELD_OUT).collect()]
    sample = rows.where(chance <= int(min(1.0, 1.2 * size / count) * 1_000_003)).orderBy(chance, "vec_id").limit(size).toArrow()
    x = _matrix(sample.column("v"))
    apart = ~np.isin(sample.column("vec_id").to_numpy(), [t[0] for t in tests])
    x = x[apart] if 2 * apart.sum() > len(x) else x
    if not len(x):
        x = _matrix(rows.orderBy("vec_id").limit(16).toArrow().column("v"))
    lifted = np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]])
    index = Centroids(two_levels(lifted, max(1, min(lists, len(x) // 4))), longest)
    closure = index.closure(x[:4096], copies, spread)
    shipped = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            row, home = shipped.value.homes(_matrix(batch.column("v")), copies, closure)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(home.astype(np.int32))], names=["vec_id", "v", "list"])

    listed = shared.settle(rows.mapInArrow(place, "vec_id long, v array<double>, list int"), "lists")
    sizes = np.zeros(len(index.c), np.int64)
    for at, n in listed.groupBy("list").count().collect():  # a row a list
        sizes[at] = n
    least = 4 * copies * (k + 1)  # rows count once for each copy
    truth = _brute(rows, tests, k) if tests else []
    row, home = index.homes(np.array([t[1] for t in truth]), copies, closure) if truth else (np.zeros(0, int), np.zeros(0, int))
    homes = [set(home[row == i].tolist()) for i in range(len(truth))]
    ratio = calibrated(index, tests, truth, homes, recall, sizes, least)
    usual = [len(index.search(np.array(t[1]), ratio, sizes, least)) for t in tests]
    width = 1 << int(1.25 * np.median(usual or [1])).bit_length()
    # lists stand in the order of their groups; a bundle is a stretch of them
    bundles = ((np.cumsum(sizes) - sizes) // bundle).astype(np.int32)
    held = spark.sparkContext.broadcast((sizes, bundles))

    def choose(batches):
        sizes, bundles = held.value
        for batch in batches:
            query, group, some = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"))):
                found = np.sort(shipped.value.search(q, ratio, sizes, least, width))
                at, first = np.unique(bundles[found], return_index=True)
                query += [i] * len(at)
                group += at.tolist()
                some += np.split(found, first[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(query, pa.int64())), batch.column("v").take(pa.array(query, pa.int64())), pa.array(group, pa.int32()), pa.array(some, pa.list_(pa.int32()))],
                names=["query_id", "v", "bundle", "lists"],
            )

    wanted = shared.settle(asked.mapInArrow(choose, "query_id long, v array<double>, bundle int, lists array<int>"), "wanted")
    blocks = wanted.groupBy("bundle").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row a bundle, as for shards
    total = np.bincount(bundles, sizes)
    shards = spark.createDataFrame([(int(b), int(-(-n // (2 * bundle)) or 1)) for b, n in enumerate(total.tolist())], "bundle int, shards int")
    cells = F.broadcast(shared.settle(shards.join(blocks, "bundle"), "cells"))
    of = spark.createDataFrame(list(enumerate(bundles.tolist())), "list int, bundle int")
    left = wanted.join(cells, "bundle").select("bundle", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "query_id", "v", "lists")
    right = listed.join(F.broadcast(of), "list").join(cells, "bundle").select("bundle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"), "vec_id", "v", "list")
    key = ["bundle", "block", "shard"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(k, copies), "query_id long, vec_id long, score double")
    return best_rows(met, k)


# The query's result in DuckDB's SQL: all pairs. Up to 511 vectors make one list, and the search is exact; above that its recall is measured instead.
ORACLE = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""
