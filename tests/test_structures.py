"""Grids of boxes, streams with state, merges without shuffles, counters of writes, prefix sums, digit runs and coordinate metadata."""

import random
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from trajspark.functions import text
from trajspark.operators import elements, grid, metrics, quality, steps
from trajspark.sources import files, merge
from trajspark.streaming import append, history

NODE = "id:int,bbox:array<double>,text:string,is_clickable:boolean,is_long_clickable:boolean"


def screens(rng, n_screens, most):
    boxes, points = [], []
    for s in range(n_screens):
        for i in range(rng.randint(0, most)):
            w, h = rng.choice([(0.01, 0.01), (0.3, 0.02), (1.0, 1.0), (0.0, 0.0), (3.0, 0.1), (0.25, 0.25)])
            x, y = rng.choice([rng.random(), 0.25, 0.5, -1.0]), rng.choice([rng.random(), 0.5])
            boxes.append((s, i, [x, y, x + w, y + h] if rng.random() > 0.05 else [x, y, x - w, y + h], rng.random() < 0.3))
        points += [(s, 100 * s + i, rng.choice([rng.random(), 0.25, 0.5, 0.26]), rng.choice([rng.random(), 0.5, 0.52])) for i in range(40)]
    return boxes, points


def test_grid_equals_the_rule_on_arrays(spark):
    boxes, points = screens(random.Random(6), 12, 40)
    b = spark.createDataFrame(boxes, "screen int, box_id int, bbox array<double>, pressable boolean")
    p = spark.createDataFrame(points, "screen int, point_id int, x double, y double")
    got = {r.point_id: r.box_id for r in grid.meant_boxes(p, b, ["screen"]).collect()}
    node = F.struct(F.col("box_id").alias("id"), "bbox", F.lit("").alias("text"), F.col("pressable").alias("is_clickable"), F.lit(False).alias("is_long_clickable"))
    nodes = b.groupBy("screen").agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    want = {r.point_id: r.box_id for r in p.join(nodes, "screen", "left").select("point_id", F.get("nodes", elements.element_at(F.col("nodes"), F.col("x"), F.col("y")))["id"].alias("box_id")).collect()}
    assert got == want and len({v is None for v in got.values()}) == 2


def test_grid_of_odd_rows(spark):
    boxes = [("a", 1, [0.0, 0.0, float("nan"), 1.0], True), ("a", 2, None, True), ("a", 3, [0.1], True), ("a", 4, [0.1, 0.1, float("inf"), 1.0], True), ("a", 5, [0.4, 0.4, 0.6, 0.6], None), ("b", 6, [0.4, 0.4, 0.6, 0.6], True)]
    points = [("a", 1, 0.5, 0.5), ("a", 2, None, 0.5), ("a", 3, 0.1, 0.1), ("c", 4, 0.5, 0.5), (None, 5, 0.5, 0.5)]
    b = spark.createDataFrame(boxes, "screen string, box_id int, bbox array<double>, pressable boolean")
    p = spark.createDataFrame(points, "screen string, point_id int, x double, y double")
    assert {r.point_id: r.box_id for r in grid.meant_boxes(p, b, ["screen"]).collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None}
    assert grid.meant_boxes(p, b.where("false"), ["screen"]).count() == 5 and grid.meant_boxes(p.where("false"), b, ["screen"]).count() == 0


def test_stream_stops_before_the_commit(spark, tmp_path):
    rows = spark.range(90).select(F.col("id"), (F.col("id") % 7).alias("v"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    target, log = str(tmp_path / "out"), str(tmp_path / "log")
    written = []

    def stop(batch):
        written.append(batch)
        if written.count(batch) == 1:
            raise RuntimeError("stopped here")

    for _ in range(3):
        with pytest.raises(StreamingQueryException):
            append.append_stream(stream(), target, log, stop).awaitTermination()
    append.append_stream(stream(), target, log, stop).awaitTermination()
    assert written == [0, 0, 1, 1, 2, 2]
    found = append.appended(spark, target, "id BIGINT, v BIGINT")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))


def test_history_of_an_episode():
    rng = random.Random(1)
    values = [rng.choice("ab") for _ in range(40)]
    order = [*range(40), *rng.sample(range(40), 15)]
    rng.shuffle(order)
    out, state = [], history.Episode(3).state()
    for i in order:  # state goes through its stored form after every step
        e = history.Episode.of(3, state)
        e.take(i, values[i])
        out += e.ready()
        state = e.state()
    runs = [next(k for k in range(1, i + 2) if k == i + 1 or values[i - k] != values[i]) for i in range(40)]
    assert out == [(i, values[i], values[max(0, i - 3) : i], runs[i]) for i in range(40)]
    e = history.Episode(2)
    for i, v in ((4, "x"), (2, "x"), (9, None)):
        e.take(i, v)
    assert list(e.ready()) == [] and list(e.rest()) == [(2, "x", [], 1), (4, "x", ["x"], 2), (9, None, ["x", "x"], 1)]


def test_streamed_history_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([(e, i, rng.choice(["tap", "scroll", "wait"])) for e in range(9) for i in range(rng.randint(1, 30))], "episode_id long, step_index int, value string")
    rows.repartition(3, F.xxhash64("episode_id", "step_index")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    append.append_stream(history.with_history(stream), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = append.appended(spark, str(tmp_path / "out"), history.OUT)
    want = steps.runs(steps.history(rows, "value"), "value")
    of = lambda df: sorted((r.episode_id, r.step_index, r.value, r.history, r.run_length) for r in df.collect())
    assert of(got) == of(want)


def test_merge_without_a_shuffle(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 20).alias("episode_id"), F.floor(F.col("id") / 20).cast("int").alias("step_index"), F.lit("goal").alias("granularity"), F.when(F.col("id") % 20 < 9, "train").otherwise("val").alias("split"), F.lit("old").alias("v"))
    parts = [merge.write_part(rows.where(f"episode_id % 2 = {i}"), str(tmp_path / f"p{i}"), i, buckets=4) for i in range(2)]
    parts.append(merge.write_part(rows.where("episode_id = 3").withColumn("v", F.lit("new")), str(tmp_path / "p2"), 2, buckets=4))
    plan = merge.united(spark, parts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    (tmp_path / "out" / "split=gone").mkdir(parents=True)
    merge.merge_parts(parts, str(tmp_path / "out"))
    found = files.episodes(spark, str(tmp_path / "out"), "episode_id BIGINT, step_index INT, granularity STRING, v STRING")
    want = rows.withColumn("v", F.when(F.col("episode_id") == 3, "new").otherwise("old"))
    of = lambda df: sorted((r.episode_id, r.step_index, r.granularity, r.v, r.split) for r in df.collect())
    assert of(found) == of(want) and not (tmp_path / "out" / "split=gone").exists()
    at = found.select("split", "episode_id", "step_index", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    files_ = {}
    for r in sorted(at, key=lambda r: (r.f, r.i)):
        files_.setdefault(r.f, []).append((r.episode_id, r.step_index))
    assert all(x == sorted(x) for x in files_.values())
    merge.dropped(spark, parts)
    with pytest.raises(ValueError, match="buckets"):
        merge.united(spark, [parts[0], merge.Part("x", "y", 5, 0)])


def test_counters_of_a_write(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 5 == 0, "bad").when(F.col("id") % 7 == 0, "rare").alias("drop_reason"))
    counts = quality.written(rows, str(tmp_path / "o"), ["bad", "none"])
    drops = {r.drop_reason: r.n for r in quality.drops(rows).collect()}
    assert counts == {"rows": 100, "kept": drops[None], "bad": drops["bad"], "none": 0, "other": drops["rare"]}
    assert spark.read.parquet(str(tmp_path / "o")).count() == drops[None]


@pytest.mark.parametrize("groups", [1, 300])
def test_prefix_sums(spark, groups):
    rng = random.Random(9)
    rows = [(rng.randrange(groups) if groups > 1 else None, i, rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int, v long").repartition(5)
    before, want = {}, {}
    for g, i, v in rows:
        want[i] = before.get(g, 0)
        before[g] = want[i] + v
    assert {r.i: r.v_before for r in metrics.prefix_sums(df, ["g"], ["i"], ["v"]).collect()} == want


def test_digit_runs(spark):
    texts = [None, "", "abc", "1", "a12b3", "12 34", "é1😀23", "1" * 500 + "x", "a1" * 3000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.digit_runs(F.col("t")).alias("r")).collect()
    assert [None if r.r is None else [(x.start, x.digits) for x in r.r] for r in rows] == [None if t is None else [(m.start() + 1, m.group()) for m in re.finditer("[0-9]+", t)] for t in texts]


def test_too_many_skipped(spark, tmp_path):
    good, bad = '{"action": "tap", "x": 0.29, "y": 1}', '{"action": "tap", "x": 0.5, "y": 0.5, "n": 7}'
    rows = lambda n, k: spark.createDataFrame([(good,)] * n + [(bad,)] * k + [(None,), ("{",), ('{"action": "tap", "x": 2, "y": 0.1}',)], "target string")
    path = str(tmp_path / "o")
    with pytest.raises(quality.TooManySkipped):
        quality.write_coordinates(quality.with_coordinates(rows(79, 21)), path)
    assert list(tmp_path.iterdir()) == []
    assert quality.write_coordinates(quality.with_coordinates(rows(80, 20)), path) == {"rows": 103, "taps": 100, "skipped": 20}
    found = spark.read.parquet(path).where("places.found").select("places.*").first()
    assert (found.x, found.y, found.x_at, found.y_at, found.x_places, found.y_places) == (0.29, 1.0, [24, 26, 27], [35], [1.0, 0.1, 0.01], [1.0])
    assert quality.write_coordinates(quality.with_coordinates(rows(0, 3)), str(tmp_path / "few"))["skipped"] == 3  # too few taps to tell


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_are_not_broadcast(spark):
    """Points multiply where the planner doesn't count them, so a table that looks small would be broadcast."""
    p = spark.range(50).select(F.lit("a").alias("screen"), F.col("id").alias("point_id"), (F.col("id") / 50).alias("x"), (F.col("id") / 50).alias("y"))
    b = p.select("screen", F.col("point_id").alias("box_id"), F.array("x", "y", F.col("x") + 0.3, F.col("y") + 0.002).alias("bbox"), F.lit(True).alias("pressable"))
    assert "BroadcastHashJoin" not in _plan(grid.meant_boxes(p, b, ["screen"]))
    # a wide, flat box lies in few, flat cells: points far above it never meet it
    cells = grid.with_cells(b.where("box_id = 10")).select("level", "across").distinct().collect()
    assert [tuple(r) for r in cells] == [(1, 8)]


def test_rows_of_sorted_files_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "o")
    spark.range(100).select(F.col("id").alias("episode_id"), F.lit(0).alias("step_index")).coalesce(1).write.parquet(path)
    found = files.sorted_files(spark, path)
    assert "BroadcastHashJoin" not in _plan(found) and found.first().sorted


def test_boxes_take_part_by_rank(spark, monkeypatch):
    """Where the best boxes hold every point, the others are not joined; in strata the result is the same."""
    names, settle = [], grid.shared.settle
    monkeypatch.setattr(grid.shared, "settle", lambda df, name: (names.append(name), settle(df, name))[1])
    monkeypatch.setattr(grid, "FEW", 4)
    b = spark.createDataFrame([("a", i, [0.0, 0.0, 0.1 + i / 100, 0.1 + i / 100], i % 2 == 0) for i in range(64)], "screen string, box_id int, bbox array<double>, pressable boolean")
    p = spark.createDataFrame([("a", i, x, x) for i, x in enumerate([0.05, 0.05, 0.2, 0.71])], "screen string, point_id int, x double, y double")
    got = {r.point_id: r.box_id for r in grid.meant_boxes(p, b, ["screen"]).collect()}
    assert got == {0: 0, 1: 0, 2: 10, 3: 62} and 2 <= names.count("inside") <= 3
    names.clear()
    assert {r.point_id: r.box_id for r in grid.meant_boxes(p.where("point_id < 2"), b, ["screen"]).collect()} == {0: 0, 1: 0} and names.count("inside") == 1


def test_shards_grow_with_the_rows(spark, monkeypatch):
    """As many shards as the join has tasks, not a fixed number."""
    from trajspark.plans import structures

    monkeypatch.setattr(structures, "_order_records", lambda spark, sf: made(spark, sf).repartition(7))
    made = lambda spark, sf: spark.range(70).selectExpr("map('episode_id', named_struct('bytes_list', cast(array() AS array<binary>), 'float_list', cast(array() AS array<float>), 'int64_list', array(id))) AS features")
    found = structures._order_shards(spark, "")
    assert found.select("shard").distinct().count() == 7 and found.count() == 70
