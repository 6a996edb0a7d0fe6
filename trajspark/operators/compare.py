"""Two runs against each other. Key sides are made unique first, the last row winning, and what that drops is counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("both_right", "regression", "gain", "both_wrong")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def restratify(predictions: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Predictions with the granularity of their rows; drop_reason no_row where there is none. Use the three-part key where it is known."""
    out = predictions.drop("granularity").join(last_wins(rows, keys, order).select(*keys, "granularity"), keys, "left")
    return out.withColumn("drop_reason", F.when(F.col("granularity").isNull(), F.lit("no_row")))


def category(a: str = "a_ok", b: str = "b_ok"):
    return F.when(F.col(a) & F.col(b), CATEGORIES[0]).when(F.col(a), CATEGORIES[1]).when(F.col(b), CATEGORIES[2]).otherwise(CATEGORIES[3])


def head_to_head(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Inner join of two runs (keys, gt_type, pred_type, ok) on null-safe keys, with the category; the truth is a's."""
    a, b = last_wins(a, keys, order).alias("a"), last_wins(b, keys, order).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.gt_type").alias("gt_type"), F.col("a.pred_type").alias("a_pred"), F.col("b.pred_type").alias("b_pred"), F.col("a.ok").alias("a_ok"), F.col("b.ok").alias("b_ok"))
    return out.withColumn("category", category())


def buckets(compared: DataFrame) -> DataFrame:
    """n of each category and its share; both accuracies and net follow from it."""
    all_ = Window.partitionBy(F.lit(1))
    return compared.groupBy("category").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(all_))


def full_match(compared: DataFrame) -> DataFrame:
    s = lambda *c: F.sum(F.col("category").isin(*c).cast("long"))
    n = F.greatest(F.count("*"), F.lit(1))
    return compared.agg(F.count("*").alias("n"), (s("both_right", "regression") / n).alias("a"), (s("both_right", "gain") / n).alias("b"), (s("gain") - s("regression")).alias("net"))


def by_dimension(compared: DataFrame, dimension: str) -> DataFrame:
    out = compared.groupBy(dimension).pivot("category", list(CATEGORIES)).count().na.fill(0)
    return out.withColumn("net", F.col("gain") - F.col("regression"))


def by_dimensions(compared: DataFrame, dimensions: list[str]) -> DataFrame:
    """category, the dimensions, level, n: the buckets over all and by each dimension, in one pass. `level` has a bit for each dimension that a row sums over, the last one lowest."""
    sets = [["category"], *[["category", d] for d in dimensions]]
    level = sum((F.grouping(d).cast("int") * 2 ** (len(dimensions) - 1 - i) for i, d in enumerate(dimensions)), F.lit(0))
    return compared.groupingSets([[F.col(c) for c in s] for s in sets], "category", *dimensions).agg(level.alias("level"), F.count("*").alias("n"))


def predicted_in(compared: DataFrame) -> DataFrame:
    """What either run predicted in regressions and gains: category, run, pred_type, n."""
    long = compared.where(F.col("category").isin("regression", "gain")).selectExpr("category", "stack(2, 'a', a_pred, 'b', b_pred) AS (run, pred_type)")
    return long.groupBy("category", "run", "pred_type").agg(F.count("*").alias("n"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that only one run has, and keys whose values differ: keys, status."""
    a, b = a.withColumn("_in", F.lit(1)).alias("a"), b.withColumn("_in", F.lit(1)).alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}"))
    status = F.when(F.col("b._in").isNull(), "only_a").when(F.col("a._in").isNull(), "only_b").when(differ, "mismatch").otherwise("same")
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], status.alias("status"))


def verdict(parity_rows: DataFrame, marginal: int = 3) -> DataFrame:
    bad = F.sum((F.col("status") != "same").cast("long"))
    return parity_rows.agg(bad.alias("mismatches"), F.when(bad == 0, "ACCEPT").when(bad <= marginal, "MARGINAL").otherwise("FAIL").alias("verdict"))


def crosstab(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """How a key's groups in two tables overlap; keys of one table only count as null on the other side."""
    return a.select(key, left).join(b.select(key, right), key, "full_outer").groupBy(left, right).agg(F.count("*").alias("n"))
