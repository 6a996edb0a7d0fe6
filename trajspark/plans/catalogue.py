"""The queries over the driver's tables, each with the same result as SQL.

Tables stand in for trajectories: a user's events or a conversation's turns are an episode, event types are actions, and
predicting the previous step's action is the model that is scored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import actions, geometry, text
from ..operators import agentruns, compare, elements, match, metrics, quality, sampling, selection, spatial, steps, weights

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode_id, step_index, event_id, gt_type, value, props."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), index.alias("step_index"), "event_id", F.col("event_type").alias("gt_type"), "value", "props")


def predicted(rows: DataFrame, back: int = 1) -> DataFrame:
    """Scored rows of the model that repeats the action `back` steps earlier."""
    from pyspark.sql import Window

    pred = F.lag("gt_type", back).over(Window.partitionBy("episode_id").orderBy("step_index"))
    ok = F.coalesce(pred == F.col("gt_type"), F.lit(False))
    return rows.withColumn("pred_type", pred).withColumn("parsed", F.col("pred_type").isNotNull()).withColumn("type_ok", ok).withColumn("ok", ok)


_STEPS = """
WITH steps AS (SELECT user_id AS episode_id, event_id, event_type AS gt_type, value, props,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS step_index FROM events),
scored AS (SELECT *, lag(gt_type) OVER w AS pred_type, coalesce(lag(gt_type) OVER w = gt_type, false) AS ok,
  lag(gt_type, 2) OVER w AS pred2, coalesce(lag(gt_type, 2) OVER w = gt_type, false) AS ok2 FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step_index))
"""


@query(_STEPS + "SELECT gt_type, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS correct, avg(ok::INT::DOUBLE) AS accuracy FROM scored GROUP BY gt_type")
def step_accuracy_by_type(spark, sf_dir):
    return metrics.by_type(predicted(event_steps(spark, sf_dir)))


@query(_STEPS + "SELECT gt_type, coalesce(pred_type, '<parse_fail>') AS pred_type, count(*) AS n FROM scored GROUP BY ALL")
def step_confusion(spark, sf_dir):
    return metrics.confusion(predicted(event_steps(spark, sf_dir)))


@query(_STEPS + "SELECT gt_type, CAST(sum((NOT ok)::INT) AS BIGINT) AS wrong, sum((NOT ok)::INT) / CAST(sum(sum((NOT ok)::INT)) OVER () AS DOUBLE) AS share FROM scored GROUP BY gt_type HAVING sum((NOT ok)::INT) > 0")
def errors_by_type(spark, sf_dir):
    return metrics.errors_by_type(predicted(event_steps(spark, sf_dir)))


@query(_STEPS + "SELECT count(*) AS n, avg((pred_type IS NOT NULL)::INT::DOUBLE) AS parse_rate, avg(ok::INT::DOUBLE) AS action_type_accuracy, avg(ok::INT::DOUBLE) AS full_match FROM scored")
def global_rates(spark, sf_dir):
    return metrics.rates(predicted(event_steps(spark, sf_dir)))


@query(_STEPS + "SELECT count(*) AS n, avg(ok::INT::DOUBLE) AS old, avg(ok2::INT::DOUBLE) AS new, avg(ok2::INT::DOUBLE) - avg(ok::INT::DOUBLE) AS delta, CAST(sum((ok <> ok2)::INT) AS BIGINT) AS flips FROM scored")
def rescore_flips(spark, sf_dir):
    one = predicted(event_steps(spark, sf_dir)).withColumnRenamed("ok", "was").drop("pred_type")
    return metrics.rescored(predicted(one, 2))


_TURNS = """
WITH rows AS (SELECT conv_id AS episode_id, CAST(turn AS INTEGER) AS step_index, role || ':' || CAST(length(text) AS VARCHAR) AS target FROM conversations)
"""


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("episode_id"), F.col("turn").cast("int").alias("step_index"), F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("target"))


@query(_TURNS + """SELECT episode_id, step_index, CASE WHEN step_index > 0 THEN last_value(target) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS prior FROM rows""")
def prior_action_asof(spark, sf_dir):
    return steps.prior(_turns(spark, sf_dir)).select("episode_id", "step_index", "prior")


@query(_TURNS + """, p AS (SELECT step_index, lag(step_index) OVER (PARTITION BY episode_id ORDER BY step_index) AS before FROM rows)
SELECT CASE WHEN step_index = 0 THEN 'step0' WHEN before = step_index - 1 THEN 'immediate' WHEN before IS NOT NULL THEN 'nearest_earlier' ELSE 'orphan' END AS prior_kind, count(*) AS n FROM p GROUP BY ALL""")
def prior_coverage(spark, sf_dir):
    return steps.prior(_turns(spark, sf_dir)).groupBy("prior_kind").agg(F.count("*").alias("n"))


@query(_TURNS + "SELECT a.episode_id, a.step_index, b.target AS prior FROM rows a LEFT JOIN rows b ON a.episode_id = b.episode_id AND b.step_index = a.step_index - 1")
def prior_exact(spark, sf_dir):
    return steps.prior_exact(_turns(spark, sf_dir)).select("episode_id", "step_index", "prior")


@query(_TURNS + """SELECT episode_id, step_index, coalesce(string_agg(target, ',' ORDER BY other), '') AS history FROM (
  SELECT a.episode_id, a.step_index, b.target, b.step_index AS other, row_number() OVER (PARTITION BY a.episode_id, a.step_index ORDER BY b.step_index DESC) AS k
  FROM rows a LEFT JOIN rows b ON a.episode_id = b.episode_id AND b.step_index < a.step_index) WHERE k <= 2 GROUP BY ALL""")
def prior_history(spark, sf_dir):
    return steps.history(_turns(spark, sf_dir), "target", 2).select("episode_id", "step_index", F.array_join("history", ",").alias("history"))


def _compared(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    return compare.head_to_head(predicted(rows), predicted(rows, 2), ["episode_id", "step_index"], "event_id")


_CATEGORY = ", c AS (SELECT *, CASE WHEN ok AND ok2 THEN 'both_right' WHEN ok THEN 'regression' WHEN ok2 THEN 'gain' ELSE 'both_wrong' END AS category FROM scored)"


@query(_STEPS + _CATEGORY + "SELECT category, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM c GROUP BY category")
def head_to_head_buckets(spark, sf_dir):
    return compare.buckets(_compared(spark, sf_dir))


@query(_STEPS + _CATEGORY + """SELECT gt_type, count(*) FILTER (category = 'both_right') AS both_right, count(*) FILTER (category = 'regression') AS regression, count(*) FILTER (category = 'gain') AS gain,
  count(*) FILTER (category = 'both_wrong') AS both_wrong, count(*) FILTER (category = 'gain') - count(*) FILTER (category = 'regression') AS net FROM c GROUP BY gt_type""")
def head_to_head_by_type(spark, sf_dir):
    return compare.by_dimension(_compared(spark, sf_dir), "gt_type")


@query(_STEPS + _CATEGORY + "SELECT count(*) AS n, avg(ok::INT::DOUBLE) AS a, avg(ok2::INT::DOUBLE) AS b, count(*) FILTER (category = 'gain') - count(*) FILTER (category = 'regression') AS net FROM c")
def head_to_head_full_match(spark, sf_dir):
    return compare.full_match(_compared(spark, sf_dir))


@query(_STEPS + _CATEGORY + """SELECT category, run, pred_type, count(*) AS n FROM (SELECT category, 'a' AS run, pred_type FROM c UNION ALL SELECT category, 'b', pred2 FROM c) WHERE category IN ('regression', 'gain') GROUP BY ALL""")
def head_to_head_predictions(spark, sf_dir):
    return compare.predicted_in(_compared(spark, sf_dir))


def _granular(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    ok = F.length("text") % 2 == 0
    return rows.select("conv_id", "turn", F.when(F.col("role") == "assistant", "step_instruction").otherwise("goal").alias("granularity"), F.col("role").alias("gt_type"), (F.length("text") % 5 > 0).alias("parsed"), (F.length("text") % 3 > 0).alias("type_ok"), ok.alias("ok"))


@query("""SELECT CASE WHEN role = 'assistant' THEN 'step_instruction' ELSE 'goal' END AS granularity, count(*) AS n, avg((length(text) % 5 > 0)::INT::DOUBLE) AS parse_rate,
  avg((length(text) % 3 > 0)::INT::DOUBLE) AS action_type_accuracy, avg((length(text) % 2 = 0)::INT::DOUBLE) AS full_match FROM conversations GROUP BY 1""")
def granularity_rates(spark, sf_dir):
    return metrics.rates(_granular(spark, sf_dir), "granularity")


@query("""SELECT role AS gt_type, coalesce(CAST(sum((length(text) % 2 = 0)::INT) FILTER (role <> 'assistant') AS BIGINT), 0) AS goal_correct, count(*) FILTER (role <> 'assistant') AS goal_n,
  coalesce(CAST(sum((length(text) % 2 = 0)::INT) FILTER (role = 'assistant') AS BIGINT), 0) AS step_instruction_correct, count(*) FILTER (role = 'assistant') AS step_instruction_n FROM conversations GROUP BY role""")
def granularity_grid(spark, sf_dir):
    return metrics.grid(_granular(spark, sf_dir), ["goal", "step_instruction"])


@query("""WITH e AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
real AS (SELECT c.conv_id AS episode_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS INTEGER) AS step_index, CAST(n AS INTEGER) AS total_steps, role, text, n FROM conversations c JOIN e USING (conv_id)),
g AS (SELECT conv_id, text AS goal FROM conversations WHERE turn = 0)
SELECT episode_id, step_index, total_steps, CASE role WHEN 'user' THEN 'tap' WHEN 'assistant' THEN 'type' ELSE role END AS action, granularity, md5(CASE WHEN granularity = 'goal' OR step_index >= n - 1 THEN goal ELSE text END) AS instruction
FROM real JOIN g ON episode_id = conv_id, (VALUES ('goal'), ('step_instruction')) v(granularity)
UNION ALL SELECT e.conv_id, CAST(n AS INTEGER), CAST(n + 1 AS INTEGER), 'done', granularity, md5(goal) FROM e JOIN g ON e.conv_id = g.conv_id, (VALUES ('goal'), ('step_instruction')) v(granularity) WHERE e.conv_id % 2 = 0""")
def episode_explode_done(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "click").when(F.col("role") == "assistant", "input_text").otherwise(F.col("role"))
    turn = F.struct("turn", F.struct(kind.alias("action_type"), F.lit(None).cast("string").alias("app_name"), F.lit(None).cast("string").alias("direction"), F.lit("x").alias("text"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")).alias("action"), "text")
    episodes = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    screen = F.struct(F.lit("p").alias("path"), F.lit(2).alias("w"), F.lit(2).alias("h"))
    episodes = episodes.select(
        "episode_id", F.get("t", F.lit(0))["text"].alias("goal"), F.array_repeat(screen, F.size("t") + F.when(F.col("episode_id") % 2 == 0, 1).otherwise(0)).alias("screens"),
        F.transform("t", lambda t: t["action"]).alias("actions"), F.transform(F.slice("t", 1, F.size("t") - 1), lambda t: t["text"]).alias("step_instructions"),
    )
    return steps.explode_steps(episodes).select("episode_id", "step_index", "total_steps", "action.action", "granularity", F.md5(F.col("instruction").cast("binary")).alias("instruction"))


@query("""WITH s AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM customer WHERE c_custkey % 10 <> 0)
SELECT split, CASE WHEN split IS NULL THEN 'unknown_split' END AS drop_reason, count(*) AS n FROM orders LEFT JOIN s ON o_custkey = k GROUP BY ALL""")
def split_routing(spark, sf_dir):
    splits = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("episode_id"), F.when(F.col("c_custkey") % 3 == 0, "train").when(F.col("c_custkey") % 3 == 1, "val").otherwise("test").alias("split"))
    return quality.drops(steps.route(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("episode_id")), splits), "split")


@query("SELECT source, quality, count(*) AS n FROM documents FULL OUTER JOIN labels USING (doc_id) GROUP BY ALL")
def contamination_crosstab(spark, sf_dir):
    return compare.crosstab(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "source", "quality")


@query("SELECT conv_id, turn FROM conversations ORDER BY md5('3407:' || conv_id || ':' || turn), conv_id, turn LIMIT 200")
def seeded_sample(spark, sf_dir):
    return sampling.seeded_sample(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], 200)


@query("SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(10)) b LEFT JOIN (SELECT greatest(0, least(9, CAST(floor(value / 500.0::DOUBLE * 10) AS INTEGER))) AS bin, count(*) AS n FROM events GROUP BY 1) USING (bin)")
def histogram10(spark, sf_dir):
    return spatial.histogram(table(spark, sf_dir, "events"), F.col("value") / 500.0)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(p AS DOUBLE) AS p, value FROM r, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.95::DOUBLE)) q(p) WHERE i = least(n - 1, floor(n * p))""")
def nearest_rank_quantiles(spark, sf_dir):
    return spatial.quantiles(table(spark, sf_dir, "events"), "value", by=["event_type"])


@query("""SELECT l_quantity AS x, l_discount AS y, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM (SELECT round(l_quantity, 2) AS l_quantity, round(l_discount, 2) AS l_discount FROM lineitem) GROUP BY 1, 2 ORDER BY n DESC, x, y LIMIT 20""")
def coord_modes_topk(spark, sf_dir):
    return spatial.modes(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").orderBy(F.desc("n"), "x", "y").limit(20)


@query("SELECT count(DISTINCT (round(l_quantity, 2), round(l_discount, 2))) AS n FROM lineitem")
def distinct_points(spark, sf_dir):
    return spatial.distinct_points(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount")


_POINTS = "(SELECT CAST((c_custkey * 37) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS x, CAST((c_custkey * 91) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS y, * FROM customer)"


def _points(spark, sf_dir):
    part = lambda k: ((F.col("c_custkey") * k) % 1000).cast("double") / 1000.0
    return table(spark, sf_dir, "customer").select("*", part(37).alias("x"), part(91).alias("y"))


@query(f"""SELECT CAST(p AS INTEGER) AS point, CAST(sum((sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 0.05)::INT) AS BIGINT) AS n, avg((sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 0.05)::INT::DOUBLE) AS share
FROM {_POINTS}, (VALUES (0, 0.5::DOUBLE, 0.5::DOUBLE), (1, 0.5, 0.1), (2, 0.5, 0.9), (3, 0.0, 0.5), (4, 0.0, 0.0)) c(p, u, v) GROUP BY p""")
def near_canonical(spark, sf_dir):
    return spatial.near_canonical(_points(spark, sf_dir), "x", "y")


@query(f"SELECT min(x) AS min_x, max(x) AS max_x, round(avg(x), 9) AS mean_x, min(y) AS min_y, max(y) AS max_y, round(avg(y), 9) AS mean_y FROM {_POINTS}")
def coord_summary(spark, sf_dir):
    s = spatial.summary(_points(spark, sf_dir), "x", "y")
    return s.withColumns({c: F.round(c, 9) for c in ("mean_x", "mean_y")})


_BOXES = """b AS (SELECT s_nationkey, s_suppkey, s_name, s_acctbal > 3000 AS clickable, s_suppkey % 3 AS depth, x0, y0, x0 + w AS x1, y0 + w AS y1 FROM
  (SELECT *, CAST((s_suppkey * 53) % 800 AS DOUBLE) / 1000.0::DOUBLE AS x0, CAST((s_suppkey * 29) % 800 AS DOUBLE) / 1000.0::DOUBLE AS y0, 0.05::DOUBLE + CAST(s_suppkey % 7 AS DOUBLE) / 50.0::DOUBLE AS w FROM supplier)),
e AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN clickable THEN 0 ELSE 2 END, depth, (x1 - x0) * (y1 - y0), s_suppkey) AS id FROM b QUALIFY id <= 40)"""


def _screens(spark, sf_dir):
    """A nation's suppliers as a screen: at most 40 ordered nodes."""
    part = lambda k: ((F.col("s_suppkey") * k) % 800).cast("double") / 1000.0
    s = table(spark, sf_dir, "supplier").select("*", part(53).alias("x0"), part(29).alias("y0"), (F.lit(0.05) + (F.col("s_suppkey") % 7).cast("double") / 50.0).alias("w"))
    none = F.lit(None).cast("string")
    node = F.struct(
        F.array("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("w")).alias("bbox"), F.col("s_name").alias("text"), none.alias("content_description"), none.alias("view_id_resource_name"), none.alias("class_name"),
        (F.col("s_acctbal") > 3000).alias("is_clickable"), F.lit(False).alias("is_long_clickable"), F.lit(False).alias("is_editable"), (F.col("s_suppkey") % 3).cast("int").alias("depth"),
    )
    s = s.select("s_nationkey", "s_suppkey", node.alias("node"))
    s = s.select("s_nationkey", "s_suppkey", "node", elements.priority(F.col("node")).alias("p"), F.col("node.depth").alias("d"), geometry.area(F.col("node.bbox")).alias("a"))
    top = sampling.first_of_each(s, "s_nationkey", ["p", "d", "a", "s_suppkey"], elements.MOST)
    rows = top.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "node"))).alias("n"))
    return rows.select("s_nationkey", elements.ranked(F.transform("n", lambda x: x["node"])).alias("nodes"))


@query(f"""WITH {_BOXES}, t AS (SELECT c_custkey, c_nationkey, x, y FROM {_POINTS}),
inside AS (SELECT c_custkey, arg_min(id, (CASE WHEN clickable THEN 0 ELSE 1 END, area, id)) AS id FROM t JOIN e ON c_nationkey = s_nationkey AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1),
near AS (SELECT c_custkey, arg_min(id, (d, id)) AS id FROM (SELECT c_custkey, id, sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y)) AS d FROM t JOIN e ON c_nationkey = s_nationkey) WHERE d < 0.04 GROUP BY 1)
SELECT t.c_custkey, CAST(coalesce(inside.id, near.id) AS INTEGER) AS element_id FROM t LEFT JOIN inside USING (c_custkey) LEFT JOIN near USING (c_custkey)""")
def point_in_box(spark, sf_dir):
    taps = _points(spark, sf_dir).select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), "x", "y")
    return taps.join(_screens(spark, sf_dir), "s_nationkey", "left").select("c_custkey", (elements.element_at(F.col("nodes"), F.col("x"), F.col("y")) + 1).alias("element_id"))


@query(f"WITH {_BOXES} SELECT s_nationkey, string_agg('  ' || id || ': ' || substr(s_name, 1, 24), chr(10) ORDER BY id) AS legend FROM e GROUP BY 1")
def element_legend_topk(spark, sf_dir):
    return _screens(spark, sf_dir).select("s_nationkey", text.legend(elements.elements(F.col("nodes"))).alias("legend"))


@query(f"""WITH {_BOXES}, t AS (SELECT c_custkey, c_nationkey, x, y FROM {_POINTS})
SELECT count(*) AS n, CAST(sum(hit::INT) AS BIGINT) AS reachable, sum(hit::INT) / CAST(greatest(count(*), 1) AS DOUBLE) AS ratio FROM (SELECT EXISTS (SELECT 1 FROM e WHERE c_nationkey = s_nationkey AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS hit FROM t)""")
def mark_reachability(spark, sf_dir):
    taps = _points(spark, sf_dir).withColumnRenamed("c_nationkey", "s_nationkey").join(_screens(spark, sf_dir), "s_nationkey", "left")
    return metrics.reachability(taps, elements.reachable(F.col("nodes"), F.col("x"), F.col("y")), F.lit(True))


@query(f"""WITH {_BOXES} SELECT c_custkey, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM customer LEFT JOIN e ON c_nationkey = s_nationkey AND id = c_custkey % 10""")
def element_centre(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(_screens(spark, sf_dir), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    at = elements.resolved(elements.elements(F.col("nodes")), (F.col("c_custkey") % 10).cast("int"))
    return rows.select("c_custkey", at["x"].alias("cx"), at["y"].alias("cy"))


def _weights_sql(raw: str) -> str:
    return f"""WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT *, n / CAST(sum(n) OVER () AS DOUBLE) AS f FROM c),
r AS (SELECT *, {raw} AS w FROM f), a AS (SELECT *, greatest(0.2::DOUBLE, least(5.0::DOUBLE, w / sum(f * w) OVER ())) AS v FROM r) SELECT label, n, round(v / sum(f * v) OVER (), 9) AS weight FROM a"""


def _class_weights(spark, sf_dir, scheme):
    counts = weights.class_counts(table(spark, sf_dir, "orders"), "o_orderpriority")
    return weights.class_weights(counts, scheme).withColumn("weight", F.round("weight", 9))


@query(_weights_sql("1 / sqrt(f)"))
def class_weights(spark, sf_dir):
    return _class_weights(spark, sf_dir, "sqrt-inverse")


@query(_weights_sql("1 / f"))
def class_weights_inverse(spark, sf_dir):
    return _class_weights(spark, sf_dir, "inverse")


@query(_weights_sql("(1 - 0.999::DOUBLE) / greatest(1 - pow(0.999::DOUBLE, n), 1e-12::DOUBLE)"))
def class_weights_cui(spark, sf_dir):
    return _class_weights(spark, sf_dir, "cui")


_CHECKPOINTS = "r AS (SELECT o_orderstatus AS run, CAST(o_custkey % 30 AS INTEGER) * 300 AS step, floor(avg((o_totalprice > 150000)::INT::DOUBLE) * 50) / 50 AS accuracy FROM orders GROUP BY 1, 2)"


def _checkpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("run"), ((F.col("o_custkey") % 30).cast("int") * 300).alias("step"))
    return rows.agg((F.floor(F.avg((F.col("o_totalprice") > 150000).cast("double")) * 50) / 50).alias("accuracy"))


@query(f"WITH {_CHECKPOINTS} SELECT run, step, accuracy FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, step) = 1")
def best_checkpoint(spark, sf_dir):
    return selection.best(_checkpoints(spark, sf_dir), "run")


@query(_STEPS + """, a AS (SELECT gt_type, avg(ok::INT::DOUBLE) AS accuracy FROM scored GROUP BY 1), b AS (SELECT gt_type, avg(ok2::INT::DOUBLE) AS baseline FROM scored WHERE gt_type <> 'click' GROUP BY 1)
SELECT gt_type, accuracy, coalesce(baseline, 0.0::DOUBLE) AS baseline, accuracy - coalesce(baseline, 0.0::DOUBLE) AS lift FROM a LEFT JOIN b USING (gt_type)""")
def baseline_by_type(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    base = metrics.by_type(predicted(rows, 2).where("gt_type <> 'click'"))
    return selection.versus_baseline(metrics.by_type(predicted(rows)).select("gt_type", "accuracy"), base)


@query(_STEPS + "SELECT gt_type, avg(ok::INT::DOUBLE) AS accuracy, (SELECT avg(ok2::INT::DOUBLE) FROM scored) AS baseline, avg(ok::INT::DOUBLE) - (SELECT avg(ok2::INT::DOUBLE) FROM scored) AS lift FROM scored GROUP BY 1")
def metric_lift(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    base = metrics.rates(predicted(rows, 2)).select(F.col("full_match").alias("accuracy"))
    return selection.lift(metrics.by_type(predicted(rows)).select("gt_type", "accuracy"), base)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS element_id FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("element_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS element_id, event_type AS action FROM events WHERE event_id % 4 <> 0")
def json_from_text(spark, sf_dir):
    said = F.concat(F.lit("Thought: go. ```json\n"), F.concat(F.lit('{"action_type": "'), F.col("event_type"), F.lit('", "action_args": {"element_id": '), F.get_json_object("props", "$.k"), F.lit("}}")), F.lit("\n```"))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "no json").otherwise(said).alias("raw"))
    a = actions.from_json_text(F.col("object"))
    return rows.withColumn("object", text.first_json_balanced(F.col("raw"))).where("object IS NOT NULL").select("event_id", a["element_id"].alias("element_id"), a["action"].alias("action"))


_EPISODES = """ep AS (SELECT user_id, count(*) AS n, max_by(event_type, (ts, event_id)) AS last, max(value) AS most, min(value) AS least, sum((value < 20)::INT) AS lost FROM events GROUP BY 1)"""


def _agent_episodes(spark, sf_dir):
    """A user's events as an agent's episode; conditions on values stand in for outcomes."""
    step = F.struct("ts", "event_id", "event_type", "value")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    said = F.transform("s", lambda x: F.struct(F.when(x["event_type"] == "purchase", "status").when(x["event_type"] == "search", "answer").otherwise(x["event_type"]).alias("action_type"), F.when(x["value"] > 60, "infeasible").alias("goal_status")))
    return rows.select(
        "user_id", F.concat(F.lit("Task"), F.col("user_id").cast("string")).alias("task_template"), F.when(F.col("user_id") % 7 == 0, 1.0).otherwise(0.0).alias("is_successful"), F.when(F.col("user_id") % 11 == 0, "boom").alias("exception_info"),
        F.lit(1.5).alias("run_time"), F.size("s").alias("episode_length"),
        F.struct(F.transform("s", lambda x: F.when(x["value"] < 20, "nothing").otherwise("Action: {}")).alias("action_output"), said.alias("action_output_json")).alias("episode_data"),
    )


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
ep AS (SELECT user_id, count(*) AS n, max(event_type) FILTER (k = 1) AS last, max(value) FILTER (k = 1) AS v, sum((value < 20)::INT) AS lost FROM r GROUP BY 1)
SELECT CASE WHEN user_id % 11 = 0 THEN 'runtime_exception' WHEN last = 'purchase' AND v > 60 THEN 'model_gave_up_infeasible' WHEN last = 'purchase' THEN 'model_thought_complete_but_wrong'
  WHEN last = 'search' THEN 'answered_but_wrong' WHEN lost >= greatest(1, n // 2) THEN 'parse_fail_majority' ELSE 'max_steps_no_terminate' END AS mode, count(*) AS n, count(*) / CAST((SELECT count(*) FROM ep) AS DOUBLE) AS share
FROM ep WHERE user_id % 7 <> 0 GROUP BY 1""")
def failure_taxonomy(spark, sf_dir):
    return agentruns.failure_modes(_agent_episodes(spark, sf_dir))


@query("""WITH ep AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS n, CAST(sum((user_id % 7 = 0)::INT) AS BIGINT) AS successes, avg((user_id % 7 = 0)::INT::DOUBLE) AS success_rate,
  CAST(sum((user_id % 11 = 0)::INT) AS BIGINT) AS exceptions, avg(n::DOUBLE) AS mean_length, 1.5::DOUBLE AS mean_time, 1.5::DOUBLE * count(*) AS total_time FROM ep""")
def agent_rollup(spark, sf_dir):
    return agentruns.rollup(_agent_episodes(spark, sf_dir))


@query("""WITH t AS (SELECT upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Task' || c_custkey END AS task, c_acctbal > 5000 AS ok, c_custkey % 9 = 0 AS odd FROM customer)
SELECT CASE WHEN odd THEN 'Other' ELSE regexp_extract(task, '^([A-Z][a-z]+(?:[A-Z][a-z]+)?)', 1) END AS cluster, CAST(sum(ok::INT) AS BIGINT) AS successes, count(*) AS n, avg(ok::INT::DOUBLE) AS success_rate FROM t GROUP BY 1""")
def cluster_success(spark, sf_dir):
    name = F.concat(F.upper(F.substring("c_mktsegment", 1, 1)), F.lower(F.substring("c_mktsegment", 2, 100)), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("Task"), F.col("c_custkey").cast("string"))))
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("1"), name)).otherwise(name).alias("task_template"), (F.col("c_acctbal") > 5000).cast("double").alias("is_successful"))
    return agentruns.clusters(rows)


@query(_STEPS + """, i AS (SELECT *, step_index - row_number() OVER (PARTITION BY episode_id, gt_type ORDER BY step_index) AS island FROM steps), l AS (SELECT episode_id, max(n) AS longest FROM (SELECT episode_id, gt_type, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1)
SELECT count(*) AS episodes, avg((longest >= 4)::INT::DOUBLE) AS collapsed FROM l""")
def run_length_collapse(spark, sf_dir):
    return agentruns.collapse(event_steps(spark, sf_dir), "gt_type", 4)


@query(_STEPS + """, a AS (SELECT * FROM scored WHERE step_index % 10 <> 3), b AS (SELECT * FROM scored WHERE step_index % 10 <> 7)
SELECT CASE WHEN b.event_id IS NULL THEN 'only_a' WHEN a.event_id IS NULL THEN 'only_b' WHEN a.pred_type IS DISTINCT FROM b.pred2 THEN 'mismatch' ELSE 'same' END AS status, count(*) AS n
FROM a FULL OUTER JOIN b ON a.episode_id = b.episode_id AND a.step_index = b.step_index GROUP BY 1""")
def parity_diff(spark, sf_dir):
    rows = event_steps(spark, sf_dir)
    a, b = predicted(rows).where("step_index % 10 <> 3"), predicted(rows, 2).where("step_index % 10 <> 7")
    return compare.parity(a, b, ["episode_id", "step_index"], ["pred_type"]).groupBy("status").agg(F.count("*").alias("n"))


@query(_STEPS + """, r AS (SELECT gt_type AS run, row_number() OVER w AS n, avg(ok::INT::DOUBLE) OVER w AS accuracy FROM scored WINDOW w AS (PARTITION BY gt_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)) SELECT run, n, accuracy FROM r WHERE n % 25 = 0""")
def running_accuracy(spark, sf_dir):
    return metrics.running(predicted(event_steps(spark, sf_dir)).withColumn("run", F.col("gt_type")), "event_id")


_DROPS = "d AS (SELECT source AS split, CASE WHEN quality IS NULL THEN 'no_label' WHEN quality = 0 THEN 'low_quality' END AS drop_reason FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_DROPS} SELECT split, drop_reason, CAST(grouping(split, drop_reason) AS INTEGER) AS level, count(*) AS n FROM d GROUP BY ROLLUP (split, drop_reason)")
def drop_reason_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.drops_rollup(rows.select(F.col("source").alias("split"), F.when(F.col("quality").isNull(), "no_label").when(F.col("quality") == 0, "low_quality").alias("drop_reason")))


@query("SELECT role AS value, count(*) AS n, min(conv_id * 1000 + turn) AS first FROM conversations GROUP BY 1 ORDER BY n DESC, first LIMIT 3")
def most_common(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("role").alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    return sampling.most_common(rows, "value", 3, "position")


_PAIRS = f"""p AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'tap' WHEN 1 THEN 'long_press' WHEN 2 THEN 'scroll' WHEN 3 THEN 'type' WHEN 4 THEN 'open_app' WHEN 5 THEN 'wait' WHEN 6 THEN 'fly' ELSE 'tap' END AS g,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 8 = 2 AND c_custkey % 3 = 0 THEN 'scroll_down' WHEN c_custkey % 5 = 0 THEN 'Wait' WHEN c_custkey % 8 = 0 AND c_custkey % 3 = 0 THEN 'TAP'
    ELSE CASE c_custkey % 8 WHEN 0 THEN 'tap' WHEN 1 THEN 'long_press' WHEN 2 THEN 'scroll' WHEN 3 THEN 'type' WHEN 4 THEN 'open_app' WHEN 5 THEN 'wait' WHEN 6 THEN 'fly' ELSE 'tap' END END AS p, x, y,
  y AS px, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE x END AS py, c_custkey % 3 AS ge, c_custkey % 2 AS pe, CASE WHEN c_custkey % 7 = 0 THEN ' A' ELSE 'a' END AS pt FROM {_POINTS})"""


@query(f"""WITH {_PAIRS}, q AS (SELECT *, coalesce((px - x) * (px - x) + (py - y) * (py - y) <= 0.14::DOUBLE * 0.14::DOUBLE, false) AS sq, coalesce(sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= 0.14, false) AS hy, CASE WHEN p = 'scroll_down' THEN 'scroll' ELSE lower(p) END AS f, pt = 'a' AS eqd, lower(trim(pt)) = 'a' AS fd, trim(pt) = 'a' AS td FROM p)
SELECT CAST(sum((coalesce(p = g, false) AND CASE g WHEN 'tap' THEN sq WHEN 'scroll' THEN eqd WHEN 'type' THEN td WHEN 'open_app' THEN fd ELSE true END)::INT) AS BIGINT) AS coordinate,
  CAST(sum((coalesce(p = g, false) AND CASE g WHEN 'tap' THEN hy WHEN 'long_press' THEN hy WHEN 'scroll' THEN fd WHEN 'type' THEN td WHEN 'open_app' THEN fd WHEN 'wait' THEN true ELSE false END)::INT) AS BIGINT) AS restratified,
  CAST(sum((coalesce(f = g, false) AND CASE g WHEN 'tap' THEN sq WHEN 'long_press' THEN sq WHEN 'scroll' THEN eqd WHEN 'type' THEN td WHEN 'open_app' THEN fd ELSE true END)::INT) AS BIGINT) AS native,
  CAST(sum((coalesce(lower(p) = g, false) AND CASE g WHEN 'tap' THEN sq WHEN 'long_press' THEN sq WHEN 'scroll' THEN eqd WHEN 'type' THEN td WHEN 'open_app' THEN fd ELSE true END)::INT) AS BIGINT) AS mark,
  CAST(sum((coalesce(f = g, false) AND CASE g WHEN 'tap' THEN ge = pe WHEN 'long_press' THEN ge = pe WHEN 'scroll' THEN eqd WHEN 'type' THEN td WHEN 'open_app' THEN fd ELSE true END)::INT) AS BIGINT) AS element FROM q""")
def match_modes(spark, sf_dir):
    """How many predictions match under each of the five predicates."""
    k = F.col("c_custkey")
    kinds = ("tap", "long_press", "scroll", "type", "open_app", "wait", "fly")
    g = F.coalesce(*[F.when(k % 8 == i, v) for i, v in enumerate(kinds)], F.lit("tap"))
    p = F.when(k % 13 == 0, F.lit(None)).when((k % 8 == 2) & (k % 3 == 0), "scroll_down").when(k % 5 == 0, "Wait").when((k % 8 == 0) & (k % 3 == 0), "TAP").otherwise(g)
    said = F.when(k % 7 == 0, " A").otherwise("a")
    rows = _points(spark, sf_dir).select(
        actions.action(action=g, x=F.col("x"), y=F.col("y"), element_id=k % 3, text=F.lit("a"), app_name=F.lit("a"), direction=F.lit("a")).alias("gt"),
        F.when(p.isNotNull(), actions.action(action=p, x=F.col("y"), y=F.when(k % 4 > 0, F.col("x")), element_id=k % 2, text=said, app_name=said, direction=said)).alias("pred"),
    )
    a, b = F.col("pred"), F.col("gt")
    return rows.agg(*[metrics.count_if(match.match(a, b, m, xy=b, at=a) if m in ("native", "mark") else match.match(a, b, m)).alias(m) for m in match.MODES])
