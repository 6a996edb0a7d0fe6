"""Where taps go: summaries, histograms, modes, quantiles, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from .metrics import count_if, share, prefix_sums

# The points that collapsed models favour.
CANONICAL = ((0.5, 0.5), (0.5, 0.1), (0.5, 0.9), (0.0, 0.5), (0.0, 0.0))


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def histogram(rows: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """bin, n of equal bins over 0 to 1, outliers in the end bins, empty bins as 0."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(value * bins).cast("int")))
    n = rows.where(value.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").na.fill(0, ["n"])


def modes(rows: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    """Rounded points with their counts and shares."""
    n = rows.groupBy(F.round(x, digits).alias("x"), F.round(y, digits).alias("y")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def distinct_points(rows: DataFrame, x: str, y: str, digits: int = 2) -> DataFrame:
    return rows.agg(F.count_distinct(F.struct(F.round(x, digits), F.round(y, digits))).alias("n"))


def distances(rows: DataFrame, d: str, radius: float = geometry.RADIUS) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), count_if(F.col(d) <= radius).alias("within"), share(F.col(d) <= radius).alias("share"), F.max(d).alias("max"))


def quantiles(rows: DataFrame, value: str, ps: tuple[float, ...] = (0.5, 0.75, 0.95), by: list[str] | None = None) -> DataFrame:
    """The value at place floor(n p) of the sorted values, from 0 (not what percentile functions give). Values are counted first, and their counts summed in order (see `prefix_sums`)."""
    by = by or []
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = prefix_sums(n, by, [value], ["_n"])
    all_ = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    placed = placed.alias("a").join(all_.alias("b"), same).select("a.*", "b._all") if by else placed.crossJoin(F.broadcast(all_))  # one row
    placed = placed.withColumn("p", F.explode(F.array(*map(F.lit, ps)))).withColumn("_place", F.least(F.floor(F.col("_all") * F.col("p")), F.col("_all") - 1))
    return placed.where((F.col("_n_before") <= F.col("_place")) & (F.col("_place") < F.col("_n_before") + F.col("_n"))).select(*by, "p", F.col(value).alias("value"))


def near_canonical(rows: DataFrame, x: str, y: str, radius: float = 0.05) -> DataFrame:
    """n and share near each of five fixed points."""
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(u).alias("u"), F.lit(v).alias("v")) for i, (u, v) in enumerate(CANONICAL)]))
    out = rows.select(x, y, points.alias("c"))
    close = F.hypot(F.col(x) - F.col("c.u"), F.col(y) - F.col("c.v")) <= radius
    return out.groupBy(F.col("c.point").alias("point")).agg(count_if(close).alias("n"), share(close).alias("share"))


def near_misses(rows: DataFrame, d: str, wrong: Column, radius: float = geometry.RADIUS) -> DataFrame:
    """Wrong elements within the radius, and those farther."""
    return rows.agg(count_if(wrong & (F.col(d) <= radius)).alias("near"), count_if(wrong & (F.col(d) > radius)).alias("far"))
