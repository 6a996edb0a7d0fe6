"""Rates, per-type accuracy, confusion and running accuracy of scored predictions (gt_type, pred_type, parsed, type_ok, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import actions, geometry, text
from . import elements, match

PARSE_FAIL = "<parse_fail>"


def share(condition: Column) -> Column:
    """The share of rows that hold, as a double; 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def rates(rows: DataFrame, *by: str) -> DataFrame:
    """n, parse_rate, action_type_accuracy, full_match; globally or by columns (granularity, file, ...)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("parsed")).alias("parse_rate"), share(F.col("type_ok")).alias("action_type_accuracy"), share(F.col("ok")).alias("full_match"))


def by_type(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "gt_type").agg(F.count("*").alias("n"), count_if(F.col("ok")).alias("correct"), share(F.col("ok")).alias("accuracy"))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """gt_type, pred_type (<parse_fail> where there is none), n. Normalise scroll variants before, or not."""
    return rows.groupBy(*by, "gt_type", F.coalesce("pred_type", F.lit(PARSE_FAIL)).alias("pred_type")).agg(F.count("*").alias("n"))


def vocabulary(rows: DataFrame) -> DataFrame:
    """Every type that is either wanted or predicted, in order."""
    return rows.select(F.explode(F.array("gt_type", F.coalesce("pred_type", F.lit(PARSE_FAIL)))).alias("type")).where("type IS NOT NULL").distinct().orderBy("type")


def confusion_wide(rows: DataFrame, types: list[str] | None = None) -> DataFrame:
    """A column for each predicted type, by default all of them (the vocabulary is small)."""
    types = types or [r[0] for r in confusion(rows).select("pred_type").distinct().orderBy("pred_type").collect()]
    return confusion(rows).groupBy("gt_type").pivot("pred_type", types).sum("n").na.fill(0)


def by_size(rows: DataFrame, *then: str) -> DataFrame:
    """Counts, the largest first."""
    return rows.orderBy(F.desc("n"), *then)


def native_rates(rows: DataFrame, *by: str) -> DataFrame:
    """n, parse_rate as (n - failures) / max(n, 1), and full_match."""
    n, failed = F.count("*"), count_if(~F.coalesce("parsed", F.lit(False)))
    return rows.groupBy(*by).agg(n.alias("n"), ((n - failed) / F.greatest(n, F.lit(1))).alias("parse_rate"), share(F.col("ok")).alias("full_match"))


def element_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """The share of predictions (pred, gt) that name the right element; 0 without rows."""
    return rows.groupBy(*by).agg(share(match.match(F.col("pred"), F.col("gt"), "element")).alias("element_accuracy"))


def element_rescore(rows: DataFrame, by: str = "file") -> DataFrame:
    """Per file: n, full_match_radius (the stored ok), full_match_element, their difference, accuracy by type and the confusion of folded predictions."""
    hit = match.match(F.col("pred"), F.col("gt"), "element")
    pred = actions.scroll_normalised(F.col("pred"))
    said = F.coalesce(F.nullif(F.lower(pred["action"]), F.lit("")), F.lit(PARSE_FAIL))
    scored = rows.select(by, "ok", hit.alias("hit"), F.lower(text.or_empty(F.col("gt.action"))).alias("gt_type"), said.alias("pred_type"))
    cells = scored.groupBy(by, "gt_type", "pred_type").agg(F.count("*").alias("n"), count_if(F.col("hit")).alias("hits"), count_if(F.col("ok")).alias("oks"))
    types = cells.groupBy(by, "gt_type").agg(F.sum("n").alias("n"), F.sum("hits").alias("correct"), F.sum("oks").alias("oks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pred_type", "n")))).alias("row"))
    n = F.sum("n")
    entry = F.struct("gt_type", F.struct("n", "correct", (F.col("correct") / F.col("n")).alias("accuracy")).alias("v"))
    return types.groupBy(by).agg(
        n.alias("n"), (F.sum("oks") / n).alias("full_match_radius"), (F.sum("correct") / n).alias("full_match_element"), ((F.sum("correct") - F.sum("oks")) / n).alias("delta"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_type"), F.map_from_entries(F.collect_list(F.struct("gt_type", "row"))).alias("confusion"),
    )


def oracle_within(rows: DataFrame, radius: float = geometry.RADIUS) -> DataFrame:
    """Taps (gt, gt_xy, elements) for which the right element's centre lies within the radius of the true point: the ceiling of any model."""
    xy, at = F.col("gt_xy"), elements.resolved(F.col("elements"), F.col("gt.element_id"))
    eligible = (F.col("gt.action") == "tap") & xy.isNotNull()
    return reachability(rows, F.coalesce(geometry.within(at["x"], at["y"], xy[0], xy[1], radius), F.lit(False)), eligible)


def grid(rows: DataFrame, granularities: list[str]) -> DataFrame:
    """correct and n by action and granularity."""
    return rows.groupBy("gt_type").pivot("granularity", granularities).agg(count_if(F.col("ok")).alias("correct"), F.count(F.lit(1)).alias("n")).na.fill(0)


def reachability(rows: DataFrame, reachable: Column, eligible: Column) -> DataFrame:
    """The share of eligible rows whose target could be hit at all."""
    n = count_if(eligible)
    return rows.agg(n.alias("n"), count_if(eligible & reachable).alias("reachable"), (count_if(eligible & reachable) / F.greatest(n, F.lit(1))).alias("ratio"))


def rescored(rows: DataFrame, *by: str) -> DataFrame:
    """Old (was) and new (ok) accuracy, their difference and the rows that flipped."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("was")).alias("old"), share(F.col("ok")).alias("new"), (share(F.col("ok")) - share(F.col("was"))).alias("delta"), count_if(~F.col("was").eqNullSafe(F.col("ok"))).alias("flips"))


def running(rows: DataFrame, position: str, every: int = 25, by: str = "run") -> DataFrame:
    """Accuracy so far at every `every`-th row of a run, whatever the number of runs or a run's rows (see `prefix_sums`)."""
    ok = F.col("ok").cast("double")
    rows = rows.select(by, position, F.lit(1).cast("long").alias("_n"), ok.isNotNull().cast("long").alias("_k"), F.coalesce(ok, F.lit(0.0)).alias("_ok"))
    out = prefix_sums(rows, [by], [position], ["_n", "_k", "_ok"]).withColumns({c: F.col(c) + F.col(f"{c}_before") for c in ("_n", "_k", "_ok")})
    return out.where(F.col("_n") % every == 0).select(by, F.col("_n").alias("n"), (F.col("_ok") / F.nullif("_k", F.lit(0))).alias("accuracy"))


def prefix_sums(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Add for each of `values` its sum over the earlier rows of the group (`<name>_before`, 0 for the first).

    Rows are sorted by range over all groups together, so a partition holds many small groups or a piece of a large one; what pieces sum to is added up in a second pass.
    Sorted pieces are written to the shared folder once, because ranges follow from a sample. Nothing is broadcast or collected.
    """
    spark, path = rows.sparkSession, scratch.new_path(rows.sparkSession, "pieces")
    cut = rows.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id())
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    keys = [*(by or []), "_piece"]
    sums = cut.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    sums = sums.select(*keys, *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_sum_{v}") for v in values])
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = cut.alias("a").join(sums.alias("b"), pieces).select("a.*", *[f"b._sum_{v}" for v in values])
    return out.select(*rows.columns, *[(F.col(f"_sum_{v}") + F.coalesce(F.sum(v).over(here), F.lit(0))).alias(f"{v}_before") for v in values])


def flip_rate(rows: DataFrame, was: str = "down", said: str = "up") -> DataFrame:
    """Of scrolls one way, the share predicted as scrolls the other way."""
    return rows.where((F.col("gt_type") == "scroll") & (F.col("gt_direction") == was)).agg(F.count("*").alias("n"), share((F.col("pred_type") == "scroll") & (F.col("pred_direction") == said)).alias("flip_rate"))


def errors_by_type(rows: DataFrame) -> DataFrame:
    """Wrong rows by type and their share of all errors."""
    wrong = rows.where(~F.coalesce("ok", F.lit(False))).groupBy("gt_type").agg(F.count("*").alias("wrong"))
    return wrong.withColumn("share", F.col("wrong") / F.sum("wrong").over(Window.partitionBy(F.lit(1))))


def weighted_mean(rows: DataFrame, value: Column, weight: Column) -> DataFrame:
    return rows.agg((F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("mean"))


def huber(d: Column, delta: float) -> Column:
    return F.when(d < delta, 0.5 * d * d / delta).otherwise(d - 0.5 * delta)
