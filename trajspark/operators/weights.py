"""Class counts and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMES = ("inverse", "sqrt-inverse", "cui")


def _all() -> Window:
    return Window.partitionBy(F.lit(1))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    n = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.withColumn("frequency", F.col("n") / F.sum("n").over(_all()))


def class_weights(counts: DataFrame, scheme: str = "sqrt-inverse", clamp: float = 5.0, beta: float = 0.999) -> DataFrame:
    """label, n, weight: raw weights, made to average 1 over rows, clamped to 1/clamp to clamp, and made to average 1 again."""
    if scheme not in SCHEMES:
        raise ValueError(f"no such scheme: {scheme}")
    f = F.col("n") / F.sum("n").over(_all())
    raw = {"inverse": 1 / f, "sqrt-inverse": 1 / F.sqrt(f), "cui": (1 - F.lit(beta)) / F.greatest(1 - F.pow(F.lit(beta), "n"), F.lit(1e-12))}[scheme]
    out = counts.select("label", "n", f.alias("_f"), raw.alias("weight"))
    level = lambda: F.col("weight") / F.sum(F.col("_f") * F.col("weight")).over(_all())
    out = out.withColumn("weight", level()).withColumn("weight", F.greatest(F.lit(1 / clamp), F.least(F.lit(clamp), F.col("weight"))))
    return out.withColumn("weight", level()).drop("_f")


def weighted(rows: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Rows with their class's weight, 1 where it has none."""
    w = weights.select(F.col("label").alias(label), "weight")
    return rows.join(w, label, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
