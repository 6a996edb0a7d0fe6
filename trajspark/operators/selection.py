"""Checkpoints: choosing one, and setting it against a baseline. Reports are rendered from small collected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIES = {"lowest": F.asc, "highest": F.desc}


def best(rows: DataFrame, by: str, score: str = "accuracy", step: str = "step", tie: str = "lowest") -> DataFrame:
    """The step with the highest score of each run; ties by step (or by its text, tie='text')."""
    last = F.asc(F.col(step).cast("string")) if tie == "text" else TIES[tie](step)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), last))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def in_order(rows: DataFrame, step: str = "step") -> DataFrame:
    return rows.orderBy(F.asc_nulls_last(step))


def versus_baseline(rows: DataFrame, baseline: DataFrame, key: str = "gt_type") -> DataFrame:
    """By type: accuracy, the baseline's (0 where it has none) and the lift."""
    b = baseline.select(key, F.col("accuracy").alias("baseline"))
    return rows.join(b, key, "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0))).withColumn("lift", F.col("accuracy") - F.col("baseline"))


def lift(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every run against one baseline row."""
    return rows.crossJoin(F.broadcast(baseline.agg(F.first("accuracy").alias("baseline")))).withColumn("lift", F.col("accuracy") - F.col("baseline"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; of a longer one the first `most` rows, and a line that says there are more."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    found = rows.limit(most + 1).collect()
    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(v) for v in r] for r in found[:most]]]
    return "\n".join(["| " + " | ".join(line) + " |" for line in lines] + [f"(more than {most} rows)"] * (len(found) > most))
