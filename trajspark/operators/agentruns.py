"""Online agent runs: outcomes, failure modes, clusters, collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import TYPES_V2
from ..functions.text import cluster, or_empty
from .metrics import count_if, share
from .steps import runs

SUCCESS = 0.999


# Outcome names, and the pattern of an action in an output.
def failure() -> Column:
    """The outcome of an episode, by the first rule that holds."""
    out, said = F.col("episode_data.action_output"), F.col("episode_data.action_output_json")
    n, last = F.greatest(F.coalesce(F.size(out), F.lit(0)), F.lit(0)), F.try_element_at(said, F.lit(-1))
    lost = F.size(F.filter(out, lambda o: ~or_empty(o).rlike(r"(?s)Action:\s*(\{.*\})")))
    return (
        F.when(or_empty(F.col("exception_info")) != "", "runtime_exception")
        .when(n == 0, "no_steps")
        .when((last["action_type"] == "status") & (last["goal_status"] == "infeasible"), "model_gave_up_infeasible")
        .when(last["action_type"] == "status", "model_thought_complete_but_wrong")
        .when(last["action_type"] == "answer", "answered_but_wrong")
        .when(lost >= F.greatest(F.lit(1), F.floor(n / 2)), "parse_fail_majority")
        .otherwise("max_steps_no_terminate")
    )


def succeeded() -> Column:
    return F.coalesce(F.col("is_successful") >= SUCCESS, F.lit(False))


def rollup(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count("*").alias("n"), count_if(succeeded()).alias("successes"), share(succeeded()).alias("success_rate"), count_if(or_empty(F.col("exception_info")) != "").alias("exceptions"), F.avg("episode_length").alias("mean_length"), F.avg("run_time").alias("mean_time"), F.sum("run_time").alias("total_time"))


def failure_modes(episodes: DataFrame) -> DataFrame:
    """mode, n and share of all episodes, successes counted in the total."""
    all_ = episodes.agg(F.count("*").alias("_all"))
    n = episodes.where(~succeeded()).groupBy(failure().alias("mode")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(all_)).select("mode", "n", (F.col("n") / F.greatest("_all", F.lit(1))).alias("share"))


def clusters(episodes: DataFrame) -> DataFrame:
    out = episodes.groupBy(cluster(F.col("task_template")).alias("cluster")).agg(count_if(succeeded()).alias("successes"), F.count("*").alias("n"), share(succeeded()).alias("success_rate"))
    return out.orderBy(F.desc("success_rate"), "cluster")


def collapse(steps: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Episodes in which one action runs for `least` steps or more."""
    longest = runs(steps, value).groupBy("episode_id").agg(F.max("run_length").alias("longest"))
    return longest.agg(F.count("*").alias("episodes"), share(F.col("longest") >= least).alias("collapsed"))


def parse_fail_per_task(steps: DataFrame) -> DataFrame:
    return steps.groupBy("episode_id").agg(share(~F.col("parsed")).alias("rate")).agg(F.avg("rate").alias("mean_rate"))


def unknown_types(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("pred_type").isNotNull() & ~F.col("pred_type").isin(*TYPES_V2)).groupBy("pred_type").agg(F.count("*").alias("n"))


def compounded(p: Column, n: Column) -> Column:
    return F.pow(p, n)
