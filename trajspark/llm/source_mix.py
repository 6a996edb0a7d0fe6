"""Mixing sources to target weights: min-cost flow over membership patterns.

1. Documents are added up by membership pattern (the set of sources that hold them) and source.
2. Targets: sources in code point order, null last, get the weights in turn and share `share` times
   all words. No target exceeds `repeats` times its source's words; what is above is shared anew by weight until none is.
3. A min-cost flow on the small graph of patterns and sources (built on the driver; the number of
   patterns depends on the number of sources, and over MOST_PATTERNS is an error; 20,000 patterns of 50 sources take seconds) routes words from
   patterns to quotas. The first use of a word is free and each further use costs one more, which
   makes the cost convex, so repetition starts only where single use can't fill a quota.
4. Each pattern's words become documents: all get the whole number of copies, and one copy more goes
   to documents in the order of a seeded hash until the words are used up. The cut is found on
   BUCKETS sums per pattern, so only the one bucket at the cut is ever ordered.

Defined cases: null or empty texts have size 0 and take nothing. A null source is a source of its own. Documents with
equal ids and sizes are alike to the hash and differ by row only. Documents whose array of sources is null or empty take nothing. Other columns are ignored, whatever their
names. An empty table gives no rows. Words of texts of any length are counted whole.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from . import shared
from .words import Words, pieces

BUCKETS = 4096
MOST_PATTERNS = 100_000


def targets(sizes: dict[str | None, int], total: int, weights: tuple[int, ...], share: float, repeats: int) -> dict[str | None, float]:
    """The words each source should give: min(cap, level * weight) at the level where they add up to share * total."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: repeats * sizes[s] for s in names}
    order = sorted(names, key=lambda s: cap[s] / weight[s])
    full, open_weight, level = 0, sum(weight.values()), math.inf
    for s in order:
        if (share * total - full) / open_weight <= cap[s] / weight[s]:
            level = (share * total - full) / open_weight
            break
        full, open_weight = full + cap[s], open_weight - weight[s]
    return {s: min(float(cap[s]), level * weight[s]) for s in names}


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each source: as much as the quotas take, at the least cost.

    Use r (from 0) of a pattern's words costs r, and nothing else costs anything, so a cheapest augmenting path is one that starts with the least use
    still open: use 0 of all patterns is opened and the flow made maximal by blocking flows along shortest paths, then use 1, and so on.
    """
    P, S = len(supply), len(quota)
    sent: list[dict[int, int]] = [{s: 0 for s in members[p]} for p in range(P)]
    givers: list[list[int]] = [[] for _ in range(S)]
    for p in range(P):
        for s in sent[p]:
            givers[s].append(p)
    room, open_ = list(quota), [0] * P
    for _ in range(repeats):
        open_ = [o + n for o, n in zip(open_, supply)]
        while True:
            # distances of patterns and sources from those patterns that still have words
            far_p, far_s = [0 if o else -1 for o in open_], [-1] * S
            front, ends, depth = [p for p in range(P) if open_[p]], False, 0
            while front and not ends:
                new = []
                for p in front:
                    for s in sent[p]:
                        if far_s[s] < 0:
                            far_s[s] = depth + 1
                            new.append(s)
                            ends |= room[s] > 0
                depth, front = depth + 2, []
                for s in new:
                    if not ends:
                        for p in givers[s]:
                            if far_p[p] < 0 and sent[p][s]:
                                far_p[p] = depth
                                front.append(p)
            if not ends:
                break
            from_p, from_s = [_Arcs(own) for own in sent], [_Arcs(own) for own in givers]
            for start in range(P):
                while open_[start] and far_p[start] == 0:
                    path, p = [], start  # pairs (pattern, source), found by a walk that never returns to a dead end
                    while True:
                        s = next((s for s in from_p[p] if far_s[s] == far_p[p] + 1), None)
                        if s is None:
                            far_p[p] = -2
                            if not path:
                                break
                            p, _ = path.pop()
                            continue
                        if room[s]:
                            path.append((p, s))
                            break
                        q = next((q for q in from_s[s] if far_p[q] == far_s[s] + 1 and sent[q][s]), None)
                        if q is None:
                            far_s[s] = -2
                            continue
                        path.append((p, s))
                        p = q
                    if not path:
                        break
                    backs = [(path[i + 1][0], path[i][1]) for i in range(len(path) - 1)]
                    most = min(open_[start], room[path[-1][1]], *(sent[p][s] for p, s in backs))
                    for p, s in path:
                        sent[p][s] += most
                    for p, s in backs:
                        sent[p][s] -= most
                    open_[start] -= most
                    room[path[-1][1]] -= most
    return [{s: n for s, n in own.items() if n} for own in sent]


class _Arcs:
    """A node's arcs from the one looked at last; it moves on only when asked for more, because that one may have room left."""

    def __init__(self, to):
        self.to, self.place = list(to), 0

    def __iter__(self):
        while self.place < len(self.to):
            yield self.to[self.place]
            self.place += 1


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """Add the place in the seeded order: key, and its first bits as bucket."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return rows.withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("bucket", F.expr("shiftright(key, 48)"))


def _membership(docs: DataFrame, sources: str):
    """The sources of each document as a sorted array; a string column holds one."""
    if isinstance(docs.schema[sources].dataType, ArrayType):
        return F.array_sort(F.array_distinct(F.col(sources).cast("array<string>")))
    return F.array(F.col(sources).cast("string"))


def sized(rows: DataFrame) -> DataFrame:
    """The rows with size (words of text) added."""
    rows = rows.withColumn("size", F.lit(0).cast("long"))

    def measure(batches):
        for batch in pieces(batches):
            yield batch.set_column(batch.schema.get_field_index("size"), "size", pa.array(Words(batch.column("text")).counts))

    return rows.mapInArrow(measure, rows.schema)


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17) -> DataFrame:
    """For each membership pattern in `rows` (doc_id, sources, size): base copies, the last document in the seeded order to
    get one more, and the sizes and targets of its sources. A row a pattern."""
    spark = rows.sparkSession
    schema = "sources array<string>, base long, extra long, targets array<double>, source_sizes array<long>"
    found = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns")
    found = sorted(((tuple(r[0] or ()), r[1]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict[str | None, int] = {}
    for pattern, words in found:
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, sum(w for _, w in found), weights, share, repeats)
    names = {s: i for i, s in enumerate(goal)}
    flow = min_cost_flow([w for _, w in found], [[names[s] for s in p] for p, _ in found], [int(goal[s]) for s in names], repeats)
    plan = []
    for (pattern, words), sent in zip(found, flow):
        base, extra = divmod(sum(sent.values()), words) if words else (0, 0)
        plan.append((list(pattern), base, extra, [float(goal[s]) for s in pattern], [sizes[s] for s in pattern]))
    plan = spark.createDataFrame(plan, schema) if plan else spark.createDataFrame([], schema)
    rows = _placed(rows, seed)
    order = Window.partitionBy("sources").orderBy("bucket")
    sums = rows.groupBy("sources", "bucket").agg(F.sum("size").alias("words")).withColumn("until", F.sum("words").over(order))
    cut = sums.join(F.broadcast(plan), "sources").where("until > extra").groupBy("sources", "extra").agg(F.min_by(F.struct("bucket", (F.col("until") - F.col("words")).alias("before")), "bucket").alias("cut"))
    cut = cut.select("sources", "extra", "cut.bucket", "cut.before")
    inner = Window.partitionBy("sources").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = rows.join(F.broadcast(cut), ["sources", "bucket"]).withColumn("until", F.col("before") + F.sum("size").over(inner))
    fits = F.when(2 * F.col("until") - F.col("size") <= 2 * F.col("extra"), F.struct("key", "doc_id", "size"))
    # where nothing of the bucket fits, what lies before the bucket does
    last = at.groupBy("sources", "bucket").agg(F.max(fits).alias("last")).select("sources", F.coalesce("last", F.struct(F.expr("shiftleft(bucket, 48) - 1").alias("key"), F.lit(9223372036854775807).alias("doc_id"), F.lit(9223372036854775807).alias("size"))).alias("last"))
    return shared.settle(plan.join(last, "sources", "left"), "mix")


def with_copies(rows: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """Add copies, taken, targets and source_sizes to `rows` (doc_id, sources, size and any others)."""
    plan = F.broadcast(plan.withColumnRenamed("sources", "_pattern"))
    more = F.coalesce(F.struct("key", "doc_id", "size") <= F.col("last"), F.lit(False)).cast("long")
    out = _placed(rows, seed).join(plan, F.expr("sources <=> _pattern"), "left")
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.coalesce("base", F.lit(0)) + more).otherwise(F.lit(0).cast("long")))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("key", "bucket", "base", "extra", "last", "_pattern")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, sources: str = "source") -> DataFrame:
    """doc_id, sources, size, copies, taken, targets and source_sizes (by source of `sources`) of every document of `docs` (doc_id, text and the column named `sources`: a string, or
    an array of them)."""
    shared.tune(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _membership(docs, sources).alias("sources"))
    rows = shared.settle(sized(slim).select("doc_id", "sources", "size"), "sizes")
    return with_copies(rows, mix_plan(rows, weights, share, repeats, seed), seed)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, sources: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, each as many times as it is taken."""
    shared.tune(docs.sparkSession)
    rows = sized(docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long"), F.col("text").cast("string"), _membership(docs, sources).alias("sources")))
    plan = mix_plan(shared.settle(rows.select("doc_id", "sources", "size"), "sizes"), weights, share, repeats, seed)
    return with_copies(rows, plan, seed).where("copies > 0").select("_row", F.explode(F.expr("sequence(1L, copies)"))).select("_row.*")


# The digest of the query in DuckDB's SQL. Each document has one source, so the flow gives each source its target.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':17'), 1, 15) AS BIGINT) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
    CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), level AS (
  SELECT *, 2 * words AS cap, 2.0::DOUBLE * words / w AS r,
    coalesce(sum(2 * words) OVER before, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_, sum(words) OVER () AS total
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * words / w, source COLLATE "C" NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pick AS (
  SELECT arg_min((1.5::DOUBLE * total - full_) / open_, r) FILTER ((1.5::DOUBLE * total - full_) / open_ <= r) AS l FROM level
), t AS (
  SELECT source, words, least(CAST(cap AS DOUBLE), CASE WHEN l IS NULL THEN CAST(cap AS DOUBLE) ELSE l * w END) AS target FROM level, pick
), q AS (
  SELECT *, CASE WHEN words > 0 THEN CAST(floor(target) AS BIGINT) // words ELSE 0 END AS base, CASE WHEN words > 0 THEN CAST(floor(target) AS BIGINT) % words ELSE 0 END AS extra FROM t
), r AS (
  SELECT doc_id, size, words AS source_size, target, base, extra,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS until
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (base + CASE WHEN 2 * until - size <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
