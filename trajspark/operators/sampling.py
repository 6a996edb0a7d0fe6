"""Samples that come out the same each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, keys: list[str], n: int, seed: int = 3407) -> DataFrame:
    """n rows in the order of a hash of seed and key; the same rows however the table is stored."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return rows.withColumn("_h", key).orderBy("_h", *keys).limit(n).drop("_h")


def most_common(rows: DataFrame, value: str, k: int, position: str) -> DataFrame:
    """The k most frequent values; ties by where they come first."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first")).orderBy(F.desc("n"), "first").limit(k)


def first_rows(rows: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_of_each(rows: DataFrame, by: str, order: list[str], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def failures(rows: DataFrame, position: str, n: int = 25) -> DataFrame:
    return rows.where(~F.coalesce("ok", F.lit(False))).orderBy(position).limit(n)
