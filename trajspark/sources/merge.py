"""Sorted partial results as bucketed tables, and their merge without a shuffle.

Workers write parts that are bucketed by episode, with the same number of buckets, and sorted in each bucket. The parts' buckets line up, so a union is read bucket by bucket
(each task gets one bucket of every part), and only sorts what it has. A key that several parts hold, as when a worker ran twice, is kept once: that of the part with the greatest `order`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("episode_id", "step_index", "granularity")
_ORDER = "_part_order"


@dataclass
class Part:
    """A table in the session's catalogue, with its files under a path of their own."""

    table: str
    path: str
    buckets: int
    order: int


def write_part(rows: DataFrame, path: str, order: int, buckets: int = 64) -> Part:
    """A worker's rows, in `buckets` files sorted by KEYS. Choose as many buckets as the merged table needs tasks; all parts have the same number, and the same columns."""
    part = Part(f"part_{uuid.uuid4().hex}", path, buckets, order)
    rows.withColumn(_ORDER, F.lit(order)).repartition(buckets, KEYS[0]).write.bucketBy(buckets, KEYS[0]).sortBy(*KEYS).option("path", path).saveAsTable(part.table)
    return part


def united(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """All parts' rows, each key once, bucketed and sorted as the parts are."""
    if len({p.buckets for p in parts}) > 1:
        raise ValueError("parts have different numbers of buckets")
    # A condition that holds for all rows makes the scans give rows: a union of column batches lists partitions one after another, though the planner takes them for buckets side by side.
    rows = reduce(lambda a, b: a.unionByName(b), [spark.table(p.table).where(F.col(_ORDER) == p.order) for p in parts])
    last = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc(_ORDER)))
    once = lambda rows: rows.withColumn("_last", last).where("_last = 1").drop(_ORDER, "_last").sortWithinPartitions(*KEYS)
    out = once(rows)
    if out.rdd.getNumPartitions() != parts[0].buckets:  # buckets don't line up, whatever the reason: shuffle
        out = once(rows.repartition(parts[0].buckets, *KEYS))
    return out


def merge_parts(parts: list[Part], path: str, form: str = "parquet") -> None:
    """The parts as one table in a folder for each split; what stood at `path` before is replaced. Files hold a bucket each, sorted by split and KEYS."""
    spark = SparkSession.active()
    rows = united(spark, parts).sortWithinPartitions("split", *KEYS)
    rows.write.mode("overwrite").partitionBy("split").format(form).save(path)


def dropped(spark: SparkSession, parts: list[Part]) -> None:
    """Take the parts out of the catalogue; their files stay where they are."""
    for p in parts:
        spark.sql(f"DROP TABLE IF EXISTS {p.table}")
