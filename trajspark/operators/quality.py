"""What is dropped and why, and contracts that fail loudly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("drop_reason IS NULL").drop("drop_reason")


def drops(rows: DataFrame, *by: str) -> DataFrame:
    """n by group and drop reason (null: kept)."""
    return rows.groupBy(*by, "drop_reason").agg(F.count("*").alias("n"))


def drops_rollup(rows: DataFrame, split: str = "split") -> DataFrame:
    """The same with totals over splits (level 1) and over all (level 3)."""
    return rows.rollup(split, "drop_reason").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def counts_by_split(rows: DataFrame, granularities: list[str]) -> DataFrame:
    return rows.groupBy("split").pivot("granularity", granularities).count().na.fill(0)


def types_by_split(rows: DataFrame, type_: str) -> DataFrame:
    return rows.groupBy("split", type_).agg(F.count("*").alias("n"))


def require(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; an error at run time where the condition does not hold."""
    return rows.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def written(rows: DataFrame, path: str, reasons: list[str], form: str = "parquet") -> dict[str, int]:
    """Write the rows without a drop reason, and return what that pass has seen: rows, kept, each of `reasons`, and other (reasons not named). No second scan."""
    seen, reason = Observation(), F.col("drop_reason")
    of = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    counts = [of(reason == r).alias(f"r{i}") for i, r in enumerate(reasons)]
    kept(rows.observe(seen, F.count(F.lit(1)).alias("rows"), of(reason.isNull()).alias("kept"), *counts)).write.format(form).save(path)
    found = seen.get
    out = {"rows": found["rows"], "kept": found["kept"]} | {r: found[f"r{i}"] for i, r in enumerate(reasons)}
    return out | {"other": out["rows"] - sum(v for k, v in out.items() if k != "rows")}


def with_coordinates(rows: DataFrame, target: str = "target") -> DataFrame:
    """Add `places` (see `text.coordinate_places`) to rows with target texts."""
    return rows.withColumn("places", text.coordinate_places(F.col(target)))


def coordinate_counters(rows: DataFrame) -> DataFrame:
    """rows, taps (with coordinates in range), skipped (taps whose digits were not found) of rows with `places`."""
    return rows.agg(F.count("*").alias("rows"), F.count("places").alias("taps"), F.count_if(~F.col("places.found")).alias("skipped"))


class TooManySkipped(ValueError):
    pass


def write_coordinates(rows: DataFrame, path: str, most: float = 0.2, least: int = 4) -> dict[str, int]:
    """Write rows with `places`, and return the counters of that same pass. With `least` taps or more, of which over `most` were skipped, it is an error and nothing is left at `path`."""
    spark, seen, part = rows.sparkSession, Observation(), f"{path}.unchecked"
    counters = [F.count(F.lit(1)).alias("rows"), F.count("places").alias("taps"), F.count_if(F.coalesce(~F.col("places.found"), F.lit(False))).alias("skipped")]
    rows.observe(seen, *counters).write.mode("overwrite").parquet(part)
    found = dict(seen.get)
    jvm = spark._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if found["taps"] >= least and found["skipped"] > most * found["taps"]:
        where.delete(at, True)
        raise TooManySkipped(f"{found['skipped']} of {found['taps']} taps skipped")
    if not where.rename(at, to):
        raise FileExistsError(path)
    return found


def missing_keys(have: Column, need: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, need)), have)
