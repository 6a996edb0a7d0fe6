"""More queries: actions, nodes, prompts, labels and scores of single rows, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import actions, geometry, text
from ..operators import agentruns, compare, elements, metrics, quality, sampling, selection, spatial, steps, weights
from ..sources import files
from .catalogue import _BOXES, _CHECKPOINTS, _PAIRS, _POINTS, _STEPS, _checkpoints, _points, _screens, _weights_sql, event_steps, predicted, query, table


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("SELECT c_custkey, x AS x6, round(x / 2, 4) AS x4, '<loc_x_' || CAST((c_custkey * 37) % 1000 AS VARCHAR) || '>' AS token, (CAST((c_custkey * 37) % 1000 AS DOUBLE) + 0.5::DOUBLE) / 1000.0::DOUBLE AS back FROM " + _POINTS)
def unit_coordinates(spark, sf_dir):
    at = F.col("x") * 1000
    rows = _points(spark, sf_dir).withColumn("token", geometry.location_token("x", F.col("x"), 1000))
    return rows.select("c_custkey", geometry.unit(F.round(at), F.lit(1000), 6).alias("x6"), geometry.unit(F.round(at), F.lit(2000), 4).alias("x4"), "token", geometry.coordinate("x", F.col("token"), 1000).alias("back"))


_RAW = {"click": "click", "view": "swipe", "purchase": "input_text", "signup": "long_press", "error": ""}


def _binary_episodes(spark, sf_dir):
    """A user's events as a decoded binary episode: one node a screen, every seventh action undecodable."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in _RAW.items()])
    k = F.col("event_id")
    point = F.when(k % 11 > 0, F.concat(F.lit(', "x": '), (k % 1000).cast("string"), F.lit(', "y": '), (k % 500).cast("string"))).otherwise("")
    raw = F.when(k % 7 == 0, "{bad").otherwise(F.concat(F.lit('{"action_type": "'), kind, F.lit('", "direction": "UP", "text": "t"'), point, F.lit("}")))
    none = F.lit(None).cast("string")
    node = F.struct(
        k.cast("int").alias("unique_id"), F.struct((k % 1000 - 100).cast("int").alias("left"), F.lit(0).alias("top"), (k % 1000).cast("int").alias("right"), F.lit(100).alias("bottom")).alias("bounds"), F.lit(" a ").alias("text"), none.alias("content_description"),
        F.lit("app:id/button").alias("view_id_resource_name"), F.lit("android.widget.Button").alias("class_name"), (k % 4 > 0).alias("is_clickable"), F.lit(False).alias("is_long_clickable"), F.lit(False).alias("is_editable"), (k % 5 > 0).alias("is_visible_to_user"), F.lit(3).alias("depth"),
    )
    step = F.struct("ts", "event_id", raw.alias("action_json"), F.when(k % 3 > 0, "do").alias("instruction"), F.lit(1000).alias("w"), F.lit(500).alias("h"), F.array(node).alias("nodes"), F.lit("i").alias("image"))
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return rows.withColumn("goal", F.lit("goal"))


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _RAW.items())} END AS kind FROM events)
SELECT user_id AS episode_id, CAST(i AS INTEGER) AS step_index, CAST(n AS INTEGER) AS total_steps, CASE WHEN event_id % 3 > 0 THEN 'do' ELSE 'goal' END AS instruction,
  CASE WHEN event_id % 7 = 0 THEN 'bad_action' END AS drop_reason, CASE WHEN event_id % 7 = 0 THEN 'wait' WHEN kind IN ('click', 'long_press') THEN CASE WHEN event_id % 11 > 0 THEN 'tap' ELSE 'wait' END WHEN kind = 'swipe' THEN 'scroll' WHEN kind = 'input_text' THEN 'type' ELSE 'wait' END AS action,
  CASE WHEN event_id % 7 > 0 AND kind IN ('click', 'long_press') AND event_id % 11 > 0 THEN CAST(event_id % 1000 AS DOUBLE) / 1000.0::DOUBLE END AS x, CASE WHEN event_id % 7 > 0 AND kind = 'swipe' THEN 'up' END AS direction,
  CASE WHEN event_id % 5 > 0 AND event_id % 1000 > 0 THEN CAST(event_id % 1000 AS DOUBLE) / 1000.0::DOUBLE END AS node_right FROM s""")
def binary_explode(spark, sf_dir):
    out = steps.explode_binary(_binary_episodes(spark, sf_dir))
    return out.select("episode_id", "step_index", "total_steps", "instruction", "drop_reason", "action.action", "action.x", "action.direction", F.get("a11y", F.lit(0))["bbox"][2].alias("node_right"))


@query("""SELECT user_id AS episode_id, CAST(sum((event_id % 5 > 0 AND event_id % 1000 > 0)::INT) AS BIGINT) AS nodes, CAST(count(*) AS BIGINT) AS steps, max(CASE WHEN event_id % 5 > 0 AND event_id % 1000 > 0 THEN 'a|button|Button' END) AS labels FROM events GROUP BY 1""")
def useful_nodes(spark, sf_dir):
    n = F.explode("steps").alias("s")
    rows = _binary_episodes(spark, sf_dir).select("episode_id", n).select("episode_id", elements.useful_nodes(F.col("s.nodes"), F.col("s.w"), F.col("s.h")).alias("a11y"))
    first = F.get("a11y", F.lit(0))
    return rows.groupBy("episode_id").agg(F.sum(F.size("a11y")).alias("nodes"), F.count("*").alias("steps"), F.max(F.when(first.isNotNull(), F.concat_ws("|", first["text"], first["view_id_resource_name"], first["class_name"]))).alias("labels"))


@query(f"WITH {_BOXES} SELECT s_nationkey, CAST(id AS INTEGER) AS id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, s_name AS label, CAST((id - 1) % 8 AS INTEGER) AS colour FROM e")
def screen_marks(spark, sf_dir):
    m = F.explode(elements.marks(F.col("nodes"))).alias("m")
    return _screens(spark, sf_dir).select("s_nationkey", m).select("s_nationkey", "m.id", "m.cx", "m.cy", "m.label", "m.colour")


@query(f"WITH {_BOXES} SELECT s_nationkey, CAST(sum(((x1 - x0) * 200 >= 16 AND (y1 - y0) * 200 >= 16)::INT) AS BIGINT) AS large FROM e GROUP BY 1")
def large_enough(spark, sf_dir):
    return _screens(spark, sf_dir).select("s_nationkey", F.size(elements.large_enough(F.col("nodes"), F.lit(200), F.lit(200))).cast("long").alias("large"))


@query(f"WITH {_BOXES}, o AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN clickable THEN 0 ELSE 1 END, area, id) AS k FROM e) SELECT s_nationkey, string_agg(s_name, ',' ORDER BY k) AS names FROM o GROUP BY 1")
def legacy_order(spark, sf_dir):
    return _screens(spark, sf_dir).select("s_nationkey", F.array_join(F.transform(elements.ranked_without_size(F.col("nodes")), lambda n: n["text"]), ",").alias("names"))


def _taps(spark, sf_dir):
    """Customers as steps on their nation's screen: taps (some without x), else scrolls."""
    k = F.col("c_custkey")
    a = actions.action(action=F.when(k % 4 == 0, "scroll").otherwise("tap"), x=F.when((k % 11 > 0) & (k % 4 > 0), F.col("x")), y=F.when(k % 4 > 0, F.col("y")), direction=F.when(k % 4 == 0, "up"))
    rows = _points(spark, sf_dir).join(_screens(spark, sf_dir), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    return rows.select("c_custkey", a.alias("action"), F.col("nodes").alias("a11y"), F.lit(1000).alias("image_w"), F.lit(1000).alias("image_h"))


_TARGETS = f"""{_BOXES}, t AS (SELECT c_custkey, c_nationkey, c_custkey % 4 > 0 AS tap, CASE WHEN c_custkey % 11 > 0 THEN x END AS x, y FROM {_POINTS}),
inside AS (SELECT c_custkey, arg_min(id, (CASE WHEN clickable THEN 0 ELSE 1 END, area, id)) AS id FROM t JOIN e ON c_nationkey = s_nationkey AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
near AS (SELECT c_custkey, arg_min(id, (d, id)) AS id FROM (SELECT c_custkey, id, sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y)) AS d FROM t JOIN e ON c_nationkey = s_nationkey) WHERE d < 0.04 GROUP BY 1),
r AS (SELECT t.*, coalesce(inside.id, near.id) AS id, c_nationkey IN (SELECT s_nationkey FROM e) AS seen FROM t LEFT JOIN inside USING (c_custkey) LEFT JOIN near USING (c_custkey)),
v AS (SELECT *, CASE WHEN NOT seen THEN 'no_a11y' WHEN tap AND x IS NULL THEN 'tap_no_xy' WHEN tap AND id IS NULL THEN 'tap_no_match' END AS drop_reason FROM r)"""


@query(f"WITH {_TARGETS} SELECT c_custkey, drop_reason, CASE WHEN tap THEN CAST(id AS INTEGER) END AS element_id, CASE WHEN tap THEN x END AS gt_x, CASE WHEN NOT tap THEN 'up' END AS direction FROM v")
def native_targets(spark, sf_dir):
    out = steps.native(_taps(spark, sf_dir))
    return out.select("c_custkey", "drop_reason", "action.element_id", F.col("gt_xy")[0].alias("gt_x"), "action.direction")


@query(f"WITH {_TARGETS} SELECT coalesce(drop_reason, CASE WHEN tap THEN 'tap_matched' ELSE 'non_tap' END) AS counter, count(*) AS n FROM v GROUP BY 1")
def native_counters(spark, sf_dir):
    return steps.native_counters(steps.native(_taps(spark, sf_dir)))


@query(f"WITH {_BOXES} SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM e)")
def rows_with_nodes(spark, sf_dir):
    return steps.with_nodes(_taps(spark, sf_dir)).agg(F.count("*").alias("n"))


_PROMPT = _literal(f"Task: t\n\n{text.SCHEMA_V1}\n\nElements:\n  1: ")


def _v1(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), F.col("turn").cast("int").alias("step_index"), "role")
    listed = F.array(F.struct(F.lit(1).alias("id"), F.col("role").alias("label")))
    said = actions.action(action=F.when(F.col("role") == "user", "tap").otherwise("wait"), element_id=F.when(F.col("role") == "user", F.col("step_index")))
    return rows.select("episode_id", "step_index", text.element_prompt(F.lit("t"), listed).alias("prompt"), said.alias("action"))


_TARGET = """CASE WHEN role = 'user' THEN '{"action_type": "tap", "action_args": {"element_id": ' || turn || '}}' ELSE '{"action_type": "wait", "action_args": {}}' END"""


@query(f"SELECT conv_id AS episode_id, CAST(turn AS INTEGER) AS step_index, md5({_PROMPT} || role) AS prompt, CASE WHEN role = 'user' THEN '{{\"action\": \"tap\", \"element_id\": ' || turn || '}}' ELSE '{{\"action\": \"wait\"}}' END AS target FROM conversations")
def prompts_v1(spark, sf_dir):
    rows = steps.samples(_v1(spark, sf_dir), F.col("prompt"))
    return rows.select("episode_id", "step_index", F.md5(text.message_text(F.col("messages"), "user").cast("binary")).alias("prompt"), text.message_text(F.col("messages"), "assistant").alias("target"))


@query(f"SELECT conv_id AS episode_id, CAST(turn AS INTEGER) AS step_index, md5(replace({_PROMPT}, {_literal(text.SCHEMA_V1)}, {_literal(text.SCHEMA_V2)}) || role) AS prompt, {_TARGET} AS target FROM conversations")
def prompts_v2(spark, sf_dir):
    return steps.to_v2(_v1(spark, sf_dir)).select("episode_id", "step_index", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "target")


@query(f"""WITH r AS (SELECT *, {_TARGET} AS target FROM conversations), p AS (SELECT *, lag(target) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM r)
SELECT conv_id AS episode_id, CAST(turn AS INTEGER) AS step_index, md5('Task: t' || chr(10) || chr(10) || 'Previous action: ' || CASE WHEN turn > 0 THEN coalesce(prior, '<none>') ELSE '<none>' END || chr(10) || chr(10) || {_literal(text.SCHEMA_V2)} || chr(10) || chr(10) || 'Elements:' || chr(10) || '  1: ' || role) AS prompt, target FROM p""")
def prompts_v3(spark, sf_dir):
    return steps.to_v3(steps.to_v2(_v1(spark, sf_dir))).select("episode_id", "step_index", F.md5(F.col("prompt").cast("binary")).alias("prompt"), "target")


@query(f"SELECT conv_id, turn, md5({_literal(text.COORDINATES)} || role) AS plain, md5({_literal('Task: ')} || role || {_literal(chr(10) * 2 + text.MARKS + chr(10) * 2 + 'Available marks:' + chr(10) + '  1: a')}) AS marked FROM conversations")
def prompts_other(spark, sf_dir):
    one = F.array(F.struct(F.lit(1).alias("id"), F.lit("a").alias("label")))
    digest = lambda c: F.md5(c.cast("binary"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest(text.coordinate_prompt(F.col("role"))).alias("plain"), digest(text.mark_prompt(F.col("role"), one)).alias("marked"))


@query(_STEPS + """, g AS (SELECT episode_id, step_index, CASE WHEN event_id % 2 = 0 THEN 'goal' ELSE 'step_instruction' END AS granularity FROM steps WHERE event_id % 10 > 0)
SELECT granularity, CASE WHEN granularity IS NULL THEN 'no_row' END AS drop_reason, count(*) AS n FROM steps LEFT JOIN g USING (episode_id, step_index) GROUP BY ALL""")
def restratified(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    known = rows.where("event_id % 10 > 0").withColumn("granularity", F.when(F.col("event_id") % 2 == 0, "goal").otherwise("step_instruction"))
    twice = known.unionByName(known.withColumn("granularity", F.lit("old")).withColumn("event_id", F.lit(-1).cast("long")))  # of doubled keys the last row counts
    return compare.restratify(predicted(rows), twice, ["episode_id", "step_index"], "event_id").groupBy("granularity", "drop_reason").agg(F.count("*").alias("n"))


@query("WITH w AS (" + _weights_sql("1 / sqrt(f)") + ") SELECT o_orderpriority, count(*) AS n, round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0::DOUBLE ELSE weight END), 3) AS total FROM orders JOIN w ON label = o_orderpriority GROUP BY 1")
def weighted_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    known = weights.class_weights(weights.class_counts(orders, "o_orderpriority")).where("label <> '5-LOW'")  # a class without weight counts once
    return weights.weighted(orders, "o_orderpriority", known).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("total"))


@query(_STEPS + "SELECT gt_type, count(*) AS n, (count(*) - count(*) FILTER (pred_type IS NULL)) / CAST(greatest(count(*), 1) AS DOUBLE) AS parse_rate, avg(ok::INT::DOUBLE) AS full_match FROM scored GROUP BY 1")
def native_rates(spark, sf_dir):
    return metrics.native_rates(predicted(event_steps(spark, sf_dir)), "gt_type")


def _pairs(spark, sf_dir):
    """The pairs of `match_modes` with a file, a stored score and columns gt and pred."""
    k = F.col("c_custkey")
    kinds = ("tap", "long_press", "scroll", "type", "open_app", "wait", "fly")
    g = F.coalesce(*[F.when(k % 8 == i, v) for i, v in enumerate(kinds)], F.lit("tap"))
    p = F.when(k % 13 == 0, F.lit(None)).when((k % 8 == 2) & (k % 3 == 0), "scroll_down").when(k % 5 == 0, "Wait").when((k % 8 == 0) & (k % 3 == 0), "TAP").otherwise(g)
    gt = actions.action(action=g, element_id=k % 3, text=F.lit("a"), app_name=F.lit("a"), direction=F.lit("down"))
    pred = F.when(p.isNotNull(), actions.action(action=p, element_id=k % 2, text=F.lit("a"), app_name=F.lit("a"), direction=F.when(p == "scroll", "down")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("file"), gt.alias("gt"), pred.alias("pred"), (k % 2 == 0).alias("ok"))


_FOLDED = f"WITH {_PAIRS}, q AS (SELECT p.*, c_mktsegment AS file, p.c_custkey % 2 = 0 AS ok, coalesce(CASE WHEN p = 'scroll_down' THEN 'scroll' ELSE lower(p) END, '<parse_fail>') AS f FROM p JOIN customer USING (c_custkey)), h AS (SELECT *, (f = g AND (g NOT IN ('tap', 'long_press') OR ge = pe))::INT AS hit FROM q)"


@query(_FOLDED + "SELECT g AS gt_type, f AS pred_type, count(*) AS n FROM h GROUP BY ALL")
def confusion_folded(spark, sf_dir):
    pred = actions.scroll_normalised(F.col("pred"))
    return metrics.confusion(_pairs(spark, sf_dir).select(F.col("gt.action").alias("gt_type"), F.lower(pred["action"]).alias("pred_type")))


@query(_STEPS + "SELECT gt_type, " + ", ".join(f"count(*) FILTER (coalesce(pred_type, '<parse_fail>') = '{t}') AS \"{t}\"" for t in ("<parse_fail>", "click", "error", "purchase", "signup", "view")) + " FROM scored GROUP BY 1")
def confusion_pivot(spark, sf_dir):
    return metrics.confusion_wide(predicted(event_steps(spark, sf_dir)))


@query(_FOLDED + "SELECT file, count(*) AS n, avg(ok::INT::DOUBLE) AS full_match_radius, avg(hit::DOUBLE) AS full_match_element, (sum(hit) - sum(ok::INT)) / CAST(count(*) AS DOUBLE) AS delta FROM h GROUP BY 1")
def element_rescore(spark, sf_dir):
    return metrics.element_rescore(_pairs(spark, sf_dir)).select("file", "n", "full_match_radius", "full_match_element", "delta")


@query(_FOLDED + "SELECT file, g AS gt_type, count(*) AS n, CAST(sum(hit) AS BIGINT) AS correct, avg(hit::DOUBLE) AS accuracy, count(*) FILTER (f = '<parse_fail>') AS failed FROM h GROUP BY 1, 2")
def element_rescore_by_type(spark, sf_dir):
    out = metrics.element_rescore(_pairs(spark, sf_dir)).select("file", "confusion", F.explode("per_type").alias("gt_type", "v"))
    return out.select("file", "gt_type", "v.n", "v.correct", "v.accuracy", F.coalesce(F.try_element_at(F.col("confusion")[F.col("gt_type")], F.lit(metrics.PARSE_FAIL)), F.lit(0)).alias("failed"))


@query(_FOLDED + "SELECT file, avg(hit::DOUBLE) AS element_accuracy FROM h GROUP BY 1")
def element_accuracy(spark, sf_dir):
    return metrics.element_accuracy(_pairs(spark, sf_dir), "file")


@query(f"""WITH {_BOXES}, t AS (SELECT c_custkey, x, y, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM {_POINTS} LEFT JOIN e ON c_nationkey = s_nationkey AND id = c_custkey % 10 WHERE c_custkey % 4 > 0)
SELECT count(*) AS n, CAST(coalesce(sum(((cx - x) * (cx - x) + (cy - y) * (cy - y) <= 0.14::DOUBLE * 0.14::DOUBLE)::INT), 0) AS BIGINT) AS reachable, coalesce(sum(((cx - x) * (cx - x) + (cy - y) * (cy - y) <= 0.14::DOUBLE * 0.14::DOUBLE)::INT), 0) / CAST(greatest(count(*), 1) AS DOUBLE) AS ratio FROM t""")
def oracle_within(spark, sf_dir):
    rows = _points(spark, sf_dir).join(_screens(spark, sf_dir), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    k = F.col("c_custkey")
    gt = actions.action(action=F.when(k % 4 > 0, "tap").otherwise("wait"), element_id=k % 10)
    return metrics.oracle_within(rows.select(gt.alias("gt"), F.array("x", "y").alias("gt_xy"), elements.elements(F.col("nodes")).alias("elements")))


_D = f"(SELECT *, sqrt((x - y) * (x - y) + (y - x) * (y - x)) AS d FROM {_POINTS} WHERE c_custkey % 9 > 0)"


def _distant(spark, sf_dir):
    """Taps with numeric strings as coordinates, some of them none, and their distance from the mirrored point."""
    k = F.col("c_custkey")
    a = F.struct(F.lit("tap").alias("action"), F.concat(F.lit(" "), F.col("x").cast("string")).alias("x"), F.when(k % 9 > 0, F.col("y").cast("string")).otherwise("none").alias("y"))
    rows = _points(spark, sf_dir).withColumn("p", geometry.tap_point(a)).where("p IS NOT NULL")
    return rows.withColumn("d", F.sqrt(geometry.squared(F.col("p.x"), F.col("p.y"), F.col("p.y"), F.col("p.x"))))


@query(f"SELECT count(*) AS n, CAST(sum((d <= 0.14)::INT) AS BIGINT) AS within, avg((d <= 0.14)::INT::DOUBLE) AS share, max(d) AS max FROM {_D}")
def tap_distances(spark, sf_dir):
    return spatial.distances(_distant(spark, sf_dir), "d")


@query(f"SELECT CAST(sum((d <= 0.14 AND c_custkey % 3 > 0)::INT) AS BIGINT) AS near, CAST(sum((d > 0.14 AND c_custkey % 3 > 0)::INT) AS BIGINT) AS far FROM {_D}")
def near_misses(spark, sf_dir):
    return spatial.near_misses(_distant(spark, sf_dir), "d", F.col("c_custkey") % 3 > 0)


@query(f"SELECT round(sum((CASE WHEN d < 0.1 THEN 0.5::DOUBLE * d * d / 0.1::DOUBLE ELSE d - 0.5::DOUBLE * 0.1::DOUBLE END) * (c_custkey % 5)) / greatest(sum(c_custkey % 5), 1.0::DOUBLE), 9) AS mean FROM {_D}")
def huber_mean(spark, sf_dir):
    return metrics.weighted_mean(_distant(spark, sf_dir), metrics.huber(F.col("d"), 0.1), (F.col("c_custkey") % 5).cast("double")).select(F.round("mean", 9).alias("mean"))


@query("SELECT o_orderstatus AS split, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"5-LOW\" FROM orders GROUP BY 1")
def counts_by_split(spark, sf_dir):
    kinds = ["1-URGENT", "5-LOW"]
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("granularity"))
    return quality.counts_by_split(rows, kinds)


@query("SELECT o_orderstatus AS split, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def types_by_split(spark, sf_dir):
    return quality.types_by_split(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "split"), "o_orderpriority")


@query(_STEPS + "SELECT CAST(sum((ok IS DISTINCT FROM ok2)::INT) AS BIGINT) AS mismatches, CASE WHEN sum((ok IS DISTINCT FROM ok2)::INT) = 0 THEN 'ACCEPT' WHEN sum((ok IS DISTINCT FROM ok2)::INT) <= 3 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM scored")
def parity_verdict(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    return compare.verdict(compare.parity(predicted(rows), predicted(rows, 2), ["episode_id", "step_index"], ["ok"]))


@query("SELECT count(*) AS n, avg((c_custkey % 3 > 0 AND c_custkey % 5 = 0)::INT::DOUBLE) AS flip_rate FROM customer WHERE c_custkey % 2 = 0")
def flip_rate(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.lit("scroll").alias("gt_type"), F.when(k % 2 == 0, "down").otherwise("up").alias("gt_direction"), F.when(k % 3 > 0, "scroll").alias("pred_type"), F.when(k % 5 == 0, "up").alias("pred_direction"))
    return metrics.flip_rate(rows)


@query(f"WITH {_CHECKPOINTS} SELECT run, step, accuracy FROM r ORDER BY step, run LIMIT 7")
def checkpoints_in_order(spark, sf_dir):
    rows = _checkpoints(spark, sf_dir)
    last = rows.agg(F.lit("x").alias("run"), F.lit(None).cast("int").alias("step"), F.lit(2.0).alias("accuracy"))  # no step comes last
    return selection.in_order(rows.unionByName(last).orderBy("run").coalesce(1)).orderBy(F.asc_nulls_last("step"), "run").limit(7)


@query(f"WITH {_CHECKPOINTS} SELECT run, max(step) FILTER (accuracy = m) AS highest, CAST(min(CAST(step AS VARCHAR)) FILTER (accuracy = m) AS INTEGER) AS by_text FROM (SELECT *, max(accuracy) OVER (PARTITION BY run) AS m FROM r) GROUP BY 1")
def best_checkpoint_ties(spark, sf_dir):
    rows = _checkpoints(spark, sf_dir)
    one = lambda tie, name: selection.best(rows, "run", tie=tie).select("run", F.col("step").alias(name))
    return one("highest", "highest").join(one("text", "by_text"), "run")


@query(_STEPS + "SELECT event_id, gt_type FROM scored WHERE NOT ok ORDER BY event_id LIMIT 25")
def failures_sample(spark, sf_dir):
    return sampling.failures(predicted(event_steps(spark, sf_dir)), "event_id").select("event_id", "gt_type")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 12")
def first_rows(spark, sf_dir):
    return sampling.first_rows(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], 12)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def most_active(spark, sf_dir):
    return metrics.by_size(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")), "user_id").limit(10)


@query(_STEPS + "SELECT DISTINCT t AS type FROM (SELECT gt_type AS t FROM scored UNION ALL SELECT coalesce(pred_type, '<parse_fail>') FROM scored)")
def vocabulary(spark, sf_dir):
    return metrics.vocabulary(predicted(event_steps(spark, sf_dir)))


@query("SELECT c_custkey AS k, c_mktsegment AS kind, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def united(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"))
    return files.union([a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))]).select("k", "kind", "balance")


@query("SELECT user_id, coalesce(string_agg(t, ',' ORDER BY t), '') AS missing FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT u.user_id, t FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('error'), ('other')) v(t) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t)) m USING (user_id) GROUP BY 1")
def missing_keys(spark, sf_dir):
    have = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", F.array_join(quality.missing_keys(F.col("have"), ["click", "error", "other"]), ",").alias("missing"))


@query("SELECT conv_id, turn, printf('%05d_%02d.png', conv_id, turn) AS file, md5(text) AS decoded, coalesce(array_to_string(regexp_extract_all(text, '[0-9]+'), ','), '') AS digits, CASE WHEN regexp_matches(text, '[0-9]') THEN CAST(length(regexp_extract(text, '^[^0-9]*')) + 1 AS INTEGER) END AS first FROM conversations")
def strings(spark, sf_dir):
    runs = text.digit_runs(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.file_name(F.col("conv_id"), F.col("turn")).alias("file"), F.md5(text.decoded(F.col("text").cast("binary")).cast("binary")).alias("decoded"),
        F.array_join(F.transform(runs, lambda r: r["digits"]), ",").alias("digits"), F.get(runs, F.lit(0))["start"].alias("first"),
    )


@query("SELECT l_orderkey, l_linenumber, pow(l_discount, l_linenumber) AS p, repeat('#', CAST(floor(l_quantity * 40 / 50) AS INTEGER)) AS bar, count(*) AS n FROM lineitem GROUP BY ALL")
def bars_and_powers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", agentruns.compounded(F.col("l_discount"), F.col("l_linenumber")).alias("p"), text.bar(F.col("l_quantity"), F.lit(50)).alias("bar"))
    return rows.groupBy("l_orderkey", "l_linenumber", "p", "bar").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, len(replace(CAST(o_custkey AS VARCHAR) || '.5', '.', '')) AS places, pow(10.0::DOUBLE, length(CAST(o_custkey AS VARCHAR)) - 1) AS highest FROM orders")
def place_values(spark, sf_dir):
    v = text.place_values(F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(v).cast("long").alias("places"), F.get(v, F.lit(0)).alias("highest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 2000 + 1 AS INTEGER) END AS w, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_nationkey + 256 AS INTEGER) END AS h FROM customer")
def image_sizes(spark, sf_dir):
    """Base64 text with a PNG's header, or something else, as it stands in episodes."""
    four = lambda n: F.lpad(F.hex(n), 8, "0")
    head = F.concat(F.when(F.col("c_custkey") % 3 > 0, "89504E470D0A1A0A").otherwise("FFD8FFE000104A46"), F.lit("0000000D49484452"), four(F.col("c_custkey") % 2000 + 1), four(F.col("c_nationkey") + 256))
    size = text.png_size(F.unbase64(F.base64(F.unhex(head))))
    return table(spark, sf_dir, "customer").select("c_custkey", size["w"].alias("w"), size["h"].alias("h"))


@query(_STEPS + "SELECT round(avg(r), 9) AS mean_rate FROM (SELECT episode_id, avg((pred_type IS NULL)::INT::DOUBLE) AS r FROM scored GROUP BY 1)")
def parse_fail_per_task(spark, sf_dir):
    return agentruns.parse_fail_per_task(predicted(event_steps(spark, sf_dir))).select(F.round("mean_rate", 9).alias("mean_rate"))


@query(_STEPS + "SELECT pred_type, count(*) AS n FROM scored WHERE pred_type IS NOT NULL GROUP BY 1")
def unknown_types(spark, sf_dir):
    return agentruns.unknown_types(predicted(event_steps(spark, sf_dir)))


@query("SELECT '| cluster | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || n || ' |', chr(10) ORDER BY role) AS report FROM (SELECT role, count(*) AS n FROM conversations GROUP BY 1)")
def markdown_report(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("cluster")).agg(F.count("*").alias("n")).orderBy("cluster")
    return spark.createDataFrame([(selection.markdown(rows),)], "report string")


@query("SELECT CAST(c_custkey % 40 AS INTEGER) AS element_id, count(*) AS n FROM customer GROUP BY 1")
def cut_numbers(spark, sf_dir):
    """Element ids that are written with decimals."""
    said = F.concat(F.lit('{"action_type": "tap", "action_args": {"element_id": '), (F.col("c_custkey") % 40).cast("string"), F.lit(".9}}"))
    a = actions.from_json_text(said)
    return table(spark, sf_dir, "customer").select(a["element_id"].alias("element_id")).groupBy("element_id").agg(F.count("*").alias("n"))
