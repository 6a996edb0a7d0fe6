"""Queries that write and read back: what comes out of the sinks and sources is compared with the tables that went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..operators import agentruns
from ..sources import files
from ..streaming import append
from .catalogue import _STEPS, _agent_episodes, event_steps, predicted, query, table


def _routed(spark, sf_dir):
    split = F.when(F.col("episode_id") % 3 == 0, "train").when(F.col("episode_id") % 3 == 1, "val").otherwise("test")
    return event_steps(spark, sf_dir).select("episode_id", "step_index", F.lit("goal").alias("granularity"), F.col("gt_type").alias("action"), split.alias("split"))


_ROUTED = _STEPS + ", r AS (SELECT episode_id, step_index, gt_type AS action, CASE episode_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM steps)"
_KIND = "episode_id BIGINT, step_index INT, granularity STRING, action STRING"


@query(_ROUTED + "SELECT episode_id, CAST(step_index AS INTEGER) AS step_index, action, split FROM r WHERE split <> 'test'")
def steps_written_and_scanned(spark, sf_dir):
    path = scratch.new_path(spark, "steps")
    files.write_steps(_routed(spark, sf_dir), path)
    return files.episodes(spark, path, _KIND, splits=["train", "val"]).select("episode_id", "step_index", "action", "split")


@query("SELECT true AS sorted")
def split_files_are_sorted(spark, sf_dir):
    """Whether each written file holds its rows in order, seen by row numbers in the file."""
    path = scratch.new_path(spark, "steps")
    files.write_steps(_routed(spark, sf_dir), path)
    rows = spark.read.parquet(path).select("split", "episode_id", "step_index", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("at", "episode_id", "step_index"))), lambda x: F.struct(x["episode_id"], x["step_index"]))
    return rows.groupBy("split", "file").agg(order.alias("o")).agg(F.bool_and(F.col("o") == F.array_sort("o")).alias("sorted"))


@query(_ROUTED + "SELECT split, count(*) AS n, CAST(sum(step_index) AS BIGINT) AS steps FROM r GROUP BY 1")
def partials_merged(spark, sf_dir):
    """Two workers' parts, over a stale result of an earlier run."""
    path, rows = scratch.new_path(spark, "merged"), _routed(spark, sf_dir)
    files.merged([rows.where("episode_id < 0"), rows], path)
    files.merged([rows.where("episode_id % 2 = 0"), rows.where("episode_id % 2 = 1")], path)
    return files.episodes(spark, path, _KIND).groupBy("split").agg(F.count("*").alias("n"), F.sum("step_index").alias("steps"))


@query("SELECT event_id, value, event_id % 10 = 0 AS bad FROM events")
def tolerant_json_lines(spark, sf_dir):
    """JSON lines, every tenth of them broken off."""
    path, rows = scratch.new_path(spark, "lines"), table(spark, sf_dir, "events").select("event_id", "value")
    line = F.to_json(F.struct("event_id", "value"))
    rows.select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "value": '), F.col("value").cast("string"), F.lit(', "x'))).otherwise(line)).write.text(path)
    found = files.json_lines(spark, path, "event_id BIGINT, value DOUBLE", tolerant=True)
    broken = F.regexp_extract("_corrupt_record", r'"event_id": (\d+), "value": ([-0-9.E]+)', 1), F.regexp_extract("_corrupt_record", r'"event_id": (\d+), "value": ([-0-9.E]+)', 2)
    return found.select(F.coalesce(F.when(F.col("_corrupt_record").isNotNull(), broken[0].cast("long")), "event_id").alias("event_id"), F.coalesce(F.when(F.col("_corrupt_record").isNotNull(), broken[1].cast("double")), "value").alias("value"), F.col("_corrupt_record").isNotNull().alias("bad"))


@query("SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def good_json_lines(spark, sf_dir):
    path, rows = scratch.new_path(spark, "lines"), table(spark, sf_dir, "events").select("event_id", "value")
    rows.select(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.to_json(F.struct("event_id", "value")))).write.text(path)
    return files.good_lines(files.json_lines(spark, path, "event_id BIGINT, value DOUBLE", tolerant=True))


@query("SELECT event_id, value FROM events")
def rewritten_in_order(spark, sf_dir):
    path = scratch.new_path(spark, "rewritten")
    files.rewrite(table(spark, sf_dir, "events").select("event_id", "value"), path, "event_id")
    return files.json_lines(spark, path, "event_id BIGINT, value DOUBLE")


@query(_STEPS + "SELECT CAST(300 * (episode_id % 4) AS INTEGER) AS step, 'val' AS kind, count(*) AS n, CAST(sum(coalesce(ok, false)::INT) AS BIGINT) AS ok, count(pred_type) AS parsed FROM scored GROUP BY 1")
def evaluation_files(spark, sf_dir):
    """Whole-document evaluation files of four checkpoints, half of them with predictions under the older name."""
    rows = predicted(event_steps(spark, sf_dir)).withColumn("step", (F.col("episode_id") % 4 * 300).cast("int"))
    act = lambda c: F.struct(F.col(c).alias("action"))
    one = lambda old: F.struct("episode_id", F.col("step_index").cast("int").alias("step_index"), act("gt_type").alias("gt"), F.when(F.col("pred_type").isNotNull(), act("pred_type")).alias("pred_parsed" if old else "pred"), "ok")
    base = scratch.new_path(spark, "evaluations")
    for i in range(4):  # a file a checkpoint
        said = rows.where(F.col("step") == 300 * i).agg(F.collect_list(one(i % 2)).alias("all_predictions")).select(F.to_json(F.struct(F.struct(F.lit(1).alias("n")).alias("metrics"), "all_predictions")).alias("value"))
        said.coalesce(1).write.text(f"{base}/runA_val_ckpt{300 * i}.d")
    # the folder's name stands for the file's, which the writer chooses
    found = files.eval_files(spark, f"{base}/*").select(F.regexp_extract(F.col("_metadata.file_path"), r"ckpt(\d+)", 1).cast("int").alias("step"), F.when(F.contains(F.col("_metadata.file_path"), F.lit("_val_")), "val").alias("kind"), "all_predictions", "file")
    p = files.predictions(found)
    return p.groupBy("step", "kind").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("ok"), F.count("pred.action").alias("parsed"))


@query("SELECT c_custkey AS episode_id, CASE WHEN c_custkey % 7 = 0 THEN 'test' WHEN c_custkey % 3 = 0 THEN 'train' WHEN c_custkey % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM customer")
def split_inversion(spark, sf_dir):
    """{split: ids} in parts of 500 customers, where ids of every seventh customer stand in `test` as well."""
    k = F.col("c_custkey")
    ids = lambda c: F.collect_list(F.when(c, k))
    doc = table(spark, sf_dir, "customer").groupBy(F.floor(k / 500)).agg(ids(k % 3 == 0).alias("train"), ids(k % 3 == 1).alias("validation"), ids((k % 3 == 2) | (k % 7 == 0)).alias("test")).select("train", "validation", "test")
    path = scratch.new_path(spark, "splits")
    doc.write.json(path)
    copy = scratch.new_path(spark, "provenance")
    files.copied(spark, path, copy)
    return files.splits(spark.read.schema("train ARRAY<BIGINT>, validation ARRAY<BIGINT>, test ARRAY<BIGINT>").json(copy))


@query("SELECT c_custkey AS episode_id, c_custkey % 2 = 0 AS app_unseen, c_custkey % 5 = 0 AS task_unseen, false AS other FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def split_flags(spark, sf_dir):
    k = F.col("c_custkey")
    doc = table(spark, sf_dir, "customer").groupBy(F.floor(k / 500)).agg(F.collect_list(F.when(k % 2 == 0, k)).alias("app_unseen"), F.collect_list(F.when(k % 5 == 0, k)).alias("task_unseen")).select("app_unseen", "task_unseen")
    flags = files.flag_maps(doc)
    wide = flags.select(F.col("episode_id").alias("id"), F.try_element_at("flags", F.lit("app_unseen")).alias("app_unseen"), F.try_element_at("flags", F.lit("task_unseen")).alias("task_unseen"))
    return files.first_found(files.flag_columns(wide.where("id < -1"), ["app_unseen", "task_unseen", "other"]), files.flag_columns(wide, ["app_unseen", "task_unseen", "other"]))


@query("SELECT run, count(*) AS n FROM (SELECT 'first' AS run FROM region UNION ALL SELECT 'second' FROM region) GROUP BY 1")
def results_appended(spark, sf_dir):
    path, rows = scratch.new_path(spark, "results"), table(spark, sf_dir, "region")
    for run in ("first", "second"):
        files.append_results(rows.select(F.lit(run).alias("run"), "r_name"), path)
    return files.json_lines(spark, path, "run STRING, r_name STRING").groupBy("run").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def metrics_dumped(spark, sf_dir):
    path = scratch.new_path(spark, "metrics")
    files.write_report(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), path)
    return files.json_lines(spark, path, "n_regionkey INT, n BIGINT")


@query("SELECT event_id % 3 AS batch, count(*) AS n FROM events WHERE event_id % 3 <> 1 GROUP BY 1")
def batches_retried(spark, sf_dir):
    """Three micro-batches, each written twice; the second time batch 1 is empty."""
    path, rows = scratch.new_path(spark, "batches"), table(spark, sf_dir, "events").select("event_id")
    write = append.batch_writer(path)
    for attempt in (0, 1):
        for batch in range(3):
            write(rows.where(f"event_id % 3 = {batch}" + (" AND false" if attempt and batch == 1 else "")), batch)
    return spark.read.schema("event_id BIGINT, batch BIGINT").parquet(path).groupBy("batch").agg(F.count("*").alias("n"))


@query("SELECT CAST(event_id % 5 AS INTEGER) AS shard, count(*) AS n FROM events WHERE event_id % 5 IN (1, 2, 4) GROUP BY 1")
def shards_scanned(spark, sf_dir):
    """All rows are written but shard 3, which is missing; shards 1 to 4 are asked for."""
    base = scratch.new_path(spark, "shards")
    for n in (0, 1, 2, 4):
        table(spark, sf_dir, "events").where(f"event_id % 5 = {n}").select("event_id").write.parquet(f"{base}/shard-{n}")
    have = files.existing(spark, [f"{base}/shard-{n}" for n in files.shard_numbers("1-3,4,25")])
    rows = spark.read.schema("event_id BIGINT").parquet(*have)
    return rows.groupBy(F.regexp_extract(F.col("_metadata.file_path"), r"shard-(\d+)", 1).cast("int").alias("shard")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def prefix_scan(spark, sf_dir):
    return files.prefix(table(spark, sf_dir, "events").select("event_id", "event_type"), 100, "event_id")


@query("WITH ep AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS n, CAST(sum((user_id % 7 = 0)::INT) AS BIGINT) AS successes, avg(n::DOUBLE) AS mean_length FROM ep")
def agent_runs_scanned(spark, sf_dir):
    """Runs in a folder of their own under the one that is asked for; the first of two counts."""
    base, rows = scratch.new_path(spark, "runs"), _agent_episodes(spark, sf_dir).drop("user_id")
    rows.write.json(f"{base}/run_1")
    rows.limit(1).write.json(f"{base}/run_2")
    return agentruns.rollup(files.agent_runs(spark, base)).select("n", "successes", "mean_length")
