"""Episodes to steps, their routing, context and the native schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import actions, text
from ..sources.records import decoded_forests
from . import elements


def explode_steps(episodes: DataFrame) -> DataFrame:
    """Mirror episodes: a goal row and an instruction row for each action, and `done` rows where a screen follows the last action.

    An instruction falls back to the goal only where the list is too short. `total_steps` is one more on `done` rows.
    """
    n = F.size("actions")
    with_steps = episodes.where(n > 0)
    real = with_steps.select("*", F.posexplode("actions").alias("step_index", "raw"))
    screen = F.get("screens", F.col("step_index"))
    told = F.when(F.col("step_index") < F.size("step_instructions"), F.get("step_instructions", F.col("step_index"))).otherwise(F.col("goal"))
    fan = lambda a, b: F.explode(F.array(*[F.named_struct(F.lit("granularity"), F.lit(g), F.lit("instruction"), i) for g, i in (("goal", a), ("step_instruction", b))]))
    keep = ["episode_id", "goal", "step_index", "total_steps", "image", "action", "g.granularity", "g.instruction"]
    real = real.select("*", n.alias("total_steps"), screen["path"].alias("image"), actions.from_mirror(F.col("raw"), screen["w"], screen["h"]).alias("action"), fan(F.col("goal"), told).alias("g")).select(*keep)
    last = with_steps.where((F.size("screens") > n) & F.get("screens", n)["path"].isNotNull())
    done = last.select("*", n.alias("step_index"), (n + 1).alias("total_steps"), F.get("screens", n)["path"].alias("image"), actions.action(action=F.lit("done")).alias("action"), fan(F.col("goal"), F.col("goal")).alias("g")).select(*keep)
    return real.unionByName(done)


def from_features(records: DataFrame) -> DataFrame:
    """Feature maps of binary records as episodes (episode_id, goal, steps) for `explode_binary`, row by row; a forest that can't be decoded has no nodes."""
    of = lambda k, kind: F.col("features")[k][kind]
    at = lambda k, kind, i: F.get(of(k, kind), i)
    rows = records.withColumn("_nodes", decoded_forests(of("accessibility_trees", "bytes_list"))).withColumn("_id", at("episode_id", "int64_list", F.lit(0)))
    step = lambda raw, i: F.struct(
        text.decoded(raw).alias("action_json"), text.decoded(at("step_instructions", "bytes_list", i)).alias("instruction"), at("screenshot_widths", "int64_list", i).cast("int").alias("w"),
        at("screenshot_heights", "int64_list", i).cast("int").alias("h"), F.get("_nodes", i).alias("nodes"), F.concat(F.lit("images/"), text.file_name(F.col("_id"), i)).alias("image"),
    )
    return rows.select(F.col("_id").alias("episode_id"), text.decoded(at("goal", "bytes_list", F.lit(0))).alias("goal"), F.transform(of("actions", "bytes_list"), step).alias("steps"))


def explode_binary(episodes: DataFrame) -> DataFrame:
    """Decoded binary episodes (episode_id, goal, steps: action_json, instruction, w, h, nodes, image): a step row an action, or a drop reason."""
    rows = episodes.select("episode_id", "goal", F.size("steps").alias("total_steps"), F.posexplode("steps").alias("step_index", "s"))
    raw = F.from_json(F.when(F.try_parse_json("s.action_json").isNotNull(), F.col("s.action_json")), "action_type STRING, app_name STRING, direction STRING, text STRING, x DOUBLE, y DOUBLE")
    return rows.select(
        "episode_id", "goal", "step_index", "total_steps", F.lit("step").alias("granularity"), F.coalesce("s.instruction", "goal").alias("instruction"), F.col("s.image").alias("image"),
        F.col("s.w").alias("image_w"), F.col("s.h").alias("image_h"), elements.useful_nodes(F.col("s.nodes"), F.col("s.w"), F.col("s.h")).alias("a11y"),
        actions.from_binary(raw, F.col("s.w"), F.col("s.h")).alias("action"), F.when(raw.isNull() | F.try_parse_json("s.action_json").isNull(), "bad_action").alias("drop_reason"),
    )


def samples(steps: DataFrame, prompt: Column) -> DataFrame:
    """Step rows as two messages: a prompt and the action's JSON."""
    return steps.select("*", text.messages(prompt, actions.to_json_v1(F.col("action"))).alias("messages"))


def route(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Add split (and drop_reason unknown_split) by episode; `splits` has one row an episode_id."""
    out = rows.join(splits, "episode_id", "left")
    return out.withColumn("drop_reason", F.when(F.col("split").isNull(), F.lit("unknown_split")))


def native(steps: DataFrame, most: int = elements.MOST, least: int = 16) -> DataFrame:
    """Steps with boxes (a11y, image_w, image_h, action) as element targets, or with a drop reason: no_a11y, empty, tap_no_xy, tap_no_match."""
    sized = F.coalesce((F.col("image_w") > 0) & (F.col("image_h") > 0), F.lit(False))
    kept = F.when(sized, elements.ranked(elements.large_enough(F.col("a11y"), F.col("image_w"), F.col("image_h"), least), most)).otherwise(elements.ranked_without_size(F.col("a11y"), most))
    rows = steps.withColumn("_nodes", kept)
    press = F.col("action.action").isin("tap", "long_press")
    rows = rows.withColumn("_at", F.when(press, elements.element_at(F.col("_nodes"), F.col("action.x"), F.col("action.y"))))
    reason = F.when(F.coalesce(F.size("a11y"), F.lit(0)) <= 0, "no_a11y").when(F.size("_nodes") == 0, "empty").when(press & (F.col("action.x").isNull() | F.col("action.y").isNull()), "tap_no_xy").when(press & F.col("_at").isNull(), "tap_no_match")
    a = F.col("action")
    return rows.select(
        *[c for c in steps.columns if c not in ("a11y", "action", "drop_reason")],
        elements.elements(F.col("_nodes")).alias("elements"),
        F.when(press, actions.with_fields(a, x=F.lit(None), y=F.lit(None), element_id=F.col("_at") + 1)).otherwise(actions.without_point(a)).alias("action"),
        F.when(press, F.array("action.x", "action.y")).alias("gt_xy"),
        reason.alias("drop_reason"),
    )


def native_counters(rows: DataFrame) -> DataFrame:
    """How `native` fared: n of each drop reason, of taps that were matched and of other actions that were kept, and of rows without screen sizes."""
    kind = F.coalesce("drop_reason", F.when(F.col("action.action") == "tap", "tap_matched").otherwise("non_tap"))
    sizeless = F.when(~F.coalesce((F.col("image_w") > 0) & (F.col("image_h") > 0), F.lit(False)), F.lit("fallback_no_dims"))
    names = F.explode(F.filter(F.array(kind, sizeless), lambda c: c.isNotNull()))
    return rows.select(names.alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def with_nodes(rows: DataFrame) -> DataFrame:
    """Rows with at least one node."""
    return rows.where(F.coalesce(F.size("a11y"), F.lit(0)) > 0)


def to_v2(rows: DataFrame) -> DataFrame:
    """Prompt and target of v1 rows (prompt, action) in the second schema; unknown types and prompts are errors."""
    return rows.withColumn("target", actions.to_json_v2(F.col("action"))).withColumn("prompt", text.schema_replaced(F.col("prompt")))


def _earlier() -> Window:
    return Window.partitionBy("episode_id").orderBy("step_index")


def prior(rows: DataFrame, value: str = "target") -> DataFrame:
    """Add prior: the value of the nearest earlier step of the episode, and prior_kind (step0, immediate, nearest_earlier, orphan).

    Step keys are unique; where they are not, the last row in `value` order counts."""
    before = _earlier().rowsBetween(Window.unboundedPreceding, -1)
    step = F.last("step_index").over(before)
    kind = F.when(F.col("step_index") == 0, "step0").when(step == F.col("step_index") - 1, "immediate").when(step.isNotNull(), "nearest_earlier").otherwise("orphan")
    return rows.withColumn("prior", F.when(F.col("step_index") > 0, F.last(value).over(before))).withColumn("prior_kind", kind)


def prior_exact(rows: DataFrame, value: str = "target") -> DataFrame:
    return rows.withColumn("prior", F.max(value).over(_earlier().rangeBetween(-1, -1)))


def to_v3(rows: DataFrame) -> DataFrame:
    """v2 rows (episode_id, step_index, prompt, target) with the prior action in the prompt."""
    out = prior(rows)
    return out.withColumn("prompt", text.prior_inserted(F.col("prompt"), F.coalesce("prior", F.lit(text.NO_PRIOR))))


def history(rows: DataFrame, value: str, depth: int = 5) -> DataFrame:
    return rows.withColumn("history", F.collect_list(value).over(_earlier().rowsBetween(-depth, -1)))


def runs(rows: DataFrame, value: str) -> DataFrame:
    """Add run_length: how long the value has been the same, up to this step (gaps and islands)."""
    w = _earlier()
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("run_length", F.row_number().over(Window.partitionBy("episode_id", "_island").orderBy("step_index"))).drop("_new", "_island")
