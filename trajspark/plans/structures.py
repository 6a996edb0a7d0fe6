"""Queries on structures of their own: grids of boxes, merges of sorted parts, streams with state, record shards; each with the same result as SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text
from ..operators import compare, elements, grid, quality, sampling, steps
from ..sources import files, merge, records
from ..streaming import append, history
from .catalogue import _BOXES, _CATEGORY, _STEPS, _TURNS, _compared, _screens, _turns, event_steps, query, table
from .storage import _KIND, _ROUTED, _routed

# Boxes: lineitem, on six screens (10,000 a screen at sf0.01). Points: orders.
_GRID = """
WITH b AS (SELECT l_orderkey % 6 AS screen, l_orderkey * 10 + l_linenumber AS box_id, (l_partkey * 7919 + l_linenumber * 13) % 10007 / 10007.0::DOUBLE AS x0, (l_suppkey * 104729 + l_orderkey) % 10009 / 10009.0::DOUBLE AS y0,
  CASE WHEN l_orderkey % 50 = 0 THEN 0.3::DOUBLE ELSE (1 + l_suppkey % 7) / 1000.0::DOUBLE END AS w, (1 + l_partkey % 5) / 1000.0::DOUBLE AS h, l_linenumber % 3 = 0 AS press FROM lineitem),
boxes AS (SELECT screen, box_id, x0, y0, x0 + w AS x1, y0 + h AS y1, press FROM b),
points AS (SELECT o_orderkey % 6 AS screen, o_orderkey AS point_id, o_orderkey * 7 % 1009 / 1009.0::DOUBLE AS x, o_custkey * 11 % 1013 / 1013.0::DOUBLE AS y FROM orders)
"""


def _grid_boxes(spark, sf_dir):
    i, k = (lambda c: F.col(c).cast("long")), F.lit
    rows = table(spark, sf_dir, "lineitem").select((i("l_orderkey") % 6).alias("screen"), (i("l_orderkey") * 10 + i("l_linenumber")).alias("box_id"), ((i("l_partkey") * 7919 + i("l_linenumber") * 13) % 10007 / k(10007.0)).alias("x0"), ((i("l_suppkey") * 104729 + i("l_orderkey")) % 10009 / k(10009.0)).alias("y0"),
        F.when(i("l_orderkey") % 50 == 0, k(0.3)).otherwise((1 + i("l_suppkey") % 7) / k(1000.0)).alias("w"), ((1 + i("l_partkey") % 5) / k(1000.0)).alias("h"), (i("l_linenumber") % 3 == 0).alias("pressable"))
    return rows.select("screen", "box_id", F.array("x0", "y0", F.col("x0") + F.col("w"), F.col("y0") + F.col("h")).alias("bbox"), "pressable")


def _grid_points(spark, sf_dir):
    i = lambda c: F.col(c).cast("long")
    return table(spark, sf_dir, "orders").select((i("o_orderkey") % 6).alias("screen"), i("o_orderkey").alias("point_id"), (i("o_orderkey") * 7 % 1009 / F.lit(1009.0)).alias("x"), (i("o_custkey") * 11 % 1013 / F.lit(1013.0)).alias("y"))


@query(_GRID + """, inside AS (SELECT point_id, arg_min(box_id, (CASE WHEN press THEN 0 ELSE 1 END, (x1 - x0) * (y1 - y0), box_id)) AS box_id FROM points JOIN boxes USING (screen) WHERE x0 <= x AND x <= x1 AND y0 <= y AND y <= y1 GROUP BY point_id),
near AS (SELECT point_id, arg_min(box_id, (d, box_id)) AS box_id FROM (SELECT point_id, box_id, sqrt(((x0 + x1) / 2 - x) * ((x0 + x1) / 2 - x) + ((y0 + y1) / 2 - y) * ((y0 + y1) / 2 - y)) AS d FROM points JOIN boxes USING (screen)) WHERE d < 0.04 GROUP BY point_id)
SELECT points.screen, points.point_id, coalesce(inside.box_id, near.box_id) AS box_id FROM points LEFT JOIN inside USING (point_id) LEFT JOIN near USING (point_id)""")
def points_in_many_boxes(spark, sf_dir):
    """Screens of thousands of boxes, as rows."""
    return grid.meant_boxes(_grid_points(spark, sf_dir), _grid_boxes(spark, sf_dir), ["screen"]).select("screen", "point_id", "box_id")


def _shuffled_files(spark, rows, parts):
    """The rows in files that a stream reads one by one, each with some of every episode's steps."""
    path = scratch.new_path(spark, "incoming")
    rows.repartition(parts, F.xxhash64("episode_id", "step_index")).write.parquet(path)
    return path


def _incoming(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


class _Stopped(Exception):
    pass


@query(_STEPS + "SELECT episode_id, step_index, gt_type AS value FROM steps")
def stream_resumed(spark, sf_dir):
    """A stream that stops twice after it has written a batch and before that is committed; each time it starts again, and no row is lost or there twice."""
    rows = event_steps(spark, sf_dir).select("episode_id", F.col("step_index").cast("int").alias("step_index"), F.col("gt_type").alias("value"))
    path = _shuffled_files(spark, rows, 4)
    target, log = scratch.new_path(spark, "appended"), scratch.new_path(spark, "log")
    stops = [1, 2]

    def stop(batch):
        if stops and batch == stops[0]:
            stops.pop(0)
            raise _Stopped

    while True:
        stream = append.append_stream(_incoming(spark, path, rows.schema), target, log, stop)
        try:
            stream.awaitTermination()
            return append.appended(spark, target, "episode_id BIGINT, step_index INT, value STRING")
        except StreamingQueryException:
            if "_Stopped" not in str(stream.exception()):
                raise


def _streamed(spark, rows, depth):
    path = _shuffled_files(spark, rows, 4)
    target, log = scratch.new_path(spark, "histories"), scratch.new_path(spark, "log")
    found = history.with_history(_incoming(spark, path, rows.schema), depth)
    append.append_stream(found, target, log).awaitTermination()
    return append.appended(spark, target, history.OUT)


@query(_TURNS + """SELECT episode_id, step_index, coalesce(string_agg(target, ',' ORDER BY other), '') AS history FROM (
  SELECT a.episode_id, a.step_index, b.target, b.step_index AS other, row_number() OVER (PARTITION BY a.episode_id, a.step_index ORDER BY b.step_index DESC) AS k
  FROM rows a LEFT JOIN rows b ON a.episode_id = b.episode_id AND b.step_index < a.step_index) WHERE k <= 2 GROUP BY ALL""")
def streamed_history(spark, sf_dir):
    """The last two turns, while turns come in any order over four micro-batches."""
    return _streamed(spark, _turns(spark, sf_dir).withColumnRenamed("target", "value"), 2).select("episode_id", "step_index", F.array_join("history", ",").alias("history"))


@query(_STEPS + """, i AS (SELECT *, step_index - row_number() OVER (PARTITION BY episode_id, gt_type ORDER BY step_index) AS island FROM steps)
SELECT episode_id, step_index, CAST(row_number() OVER (PARTITION BY episode_id, gt_type, island ORDER BY step_index) AS INTEGER) AS run_length FROM i""")
def streamed_runs(spark, sf_dir):
    rows = event_steps(spark, sf_dir).select("episode_id", F.col("step_index").cast("int").alias("step_index"), F.col("gt_type").alias("value"))
    return _streamed(spark, rows, 5).select("episode_id", "step_index", "run_length")


@query(_STEPS + _CATEGORY + """, d AS (SELECT category, CASE WHEN step_index = 0 THEN 'goal' ELSE 'step_instruction' END AS granularity, gt_type FROM c)
SELECT category, granularity, gt_type, CAST(grouping_id(granularity, gt_type) AS INTEGER) AS level, count(*) AS n FROM d GROUP BY GROUPING SETS ((category), (category, granularity), (category, gt_type))""")
def head_to_head_dimensions(spark, sf_dir):
    """The four buckets over all, by granularity and by type, in one pass."""
    rows = _compared(spark, sf_dir).withColumn("granularity", F.when(F.col("step_index") == 0, "goal").otherwise("step_instruction"))
    return compare.by_dimensions(rows, ["granularity", "gt_type"])


@query(_ROUTED + "SELECT split, count(*) AS n, CAST(sum(step_index) AS BIGINT) AS steps, CAST(count(DISTINCT (episode_id, step_index)) AS BIGINT) AS keys FROM r GROUP BY 1")
def sorted_parts_merged(spark, sf_dir):
    """Three workers' sorted, bucketed parts, one of them written twice, merged without a shuffle over a stale result."""
    rows, path = _routed(spark, sf_dir), scratch.new_path(spark, "merged")
    parts = [merge.write_part(rows.where(f"episode_id % 3 = {i}"), scratch.new_path(spark, f"part{i}"), i, buckets=8) for i in range(3)]
    merge.merge_parts(parts[:1], path)
    again = merge.write_part(rows.where("episode_id % 3 = 1"), scratch.new_path(spark, "part1"), 3, buckets=8)
    merge.merge_parts([*parts, again], path)
    found = files.episodes(spark, path, _KIND).groupBy("split").agg(F.count("*").alias("n"), F.sum("step_index").alias("steps"), F.count_distinct("episode_id", "step_index").alias("keys"))
    merge.dropped(spark, [*parts, again])
    return found


@query(_ROUTED + """, d AS (SELECT CASE WHEN split = 'test' THEN 'unknown_split' WHEN step_index % 7 = 3 THEN 'bad_action' END AS drop_reason FROM r)
SELECT coalesce(drop_reason, 'kept') AS counter, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'written', count(*) FROM d WHERE drop_reason IS NULL""")
def counted_while_written(spark, sf_dir):
    """Counters that the write itself gathers, beside the rows that it wrote."""
    reason = F.when(F.col("split") == "test", "unknown_split").when(F.col("step_index") % 7 == 3, "bad_action")
    path = scratch.new_path(spark, "counted")
    counts = quality.written(_routed(spark, sf_dir).withColumn("drop_reason", reason), path, ["unknown_split", "bad_action", "no_row"])
    rows = spark.createDataFrame([(k, v) for k, v in counts.items() if v and k not in ("rows", "other")], "counter string, n long")
    return rows.unionByName(spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit("written").alias("counter"), "n"))


def _varint(v):
    """A non-negative integer under 2**21 in three bytes."""
    v = v.cast("long")
    return F.unhex(F.lpad(F.hex((v % 128 + 128) * 65536 + (F.shiftright(v, 7) % 128 + 128) * 256 + F.shiftright(v, 14)), 6, "0"))


def _bytes_field(n, data):
    return F.concat(_varint(F.lit(n * 8 + 2)), _varint(F.octet_length(data)), data)


def _int_field(n, v):
    return F.concat(_varint(F.lit(n * 8)), _varint(v))


def _order_records(spark, sf_dir):
    """Orders as episodes of one step: a line is a node with a box of its own row on the screen, and the tap goes to the row that the customer names."""
    i = lambda c: F.col(c).cast("long")
    # a column for each depth: a field names its data twice and more, which would double with every depth in one expression
    rows = table(spark, sf_dir, "lineitem").withColumn("_box", F.concat(_int_field(1, F.lit(0)), _int_field(2, 100 * i("l_linenumber")), _int_field(3, F.lit(1000)), _int_field(4, 100 * i("l_linenumber") + 90)))
    rows = rows.withColumn("_text", F.encode(F.concat(F.lit("Line é "), F.col("l_linenumber").cast("string")), "UTF-8"))
    rows = rows.withColumn("_node", F.concat(_int_field(1, i("l_partkey") % 1000), _bytes_field(2, F.col("_box")), _bytes_field(7, F.col("_text")), _int_field(14, F.lit(1)), _int_field(23, F.lit(1)), _int_field(27, F.lit(2))))
    rows = rows.select("l_orderkey", "l_linenumber", _bytes_field(1, F.col("_node")).alias("n"))
    lines = rows.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "n"))), lambda x: x["n"]).alias("nodes"))
    lines = lines.withColumn("_joined", F.aggregate("nodes", F.unhex(F.lit("")), lambda a, n: F.concat(a, n)))
    lines = lines.withColumn("_tree", F.concat(_int_field(3, F.lit(1)), _bytes_field(11, F.col("_joined")))).select("l_orderkey", _bytes_field(1, F.col("_tree")).alias("_forest"))
    forest = F.col("_forest")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    lists = lambda b, n: F.struct(b.cast("array<binary>").alias("bytes_list"), F.array().cast("array<float>").alias("float_list"), n.cast("array<bigint>").alias("int64_list"))
    of = lambda *b: lists(F.array(*[F.encode(x, "UTF-8") if x is not None else forest for x in b]), F.array())
    one = lambda v: lists(F.array(), F.array(v))
    tap = F.to_json(F.struct(F.lit("click").alias("action_type"), F.lit(500).alias("x"), (100 * (i("o_custkey") % 9) + 45).alias("y")))
    features = {"episode_id": one(i("o_orderkey")), "goal": of(F.concat(F.lit("Order "), i("o_orderkey").cast("string"))), "actions": of(tap), "step_instructions": of(F.lit("tap it")), "screenshot_widths": one(F.lit(1000)), "screenshot_heights": one(F.lit(1000)), "accessibility_trees": of(None)}
    return rows.select(F.create_map(*[x for k, v in features.items() for x in (F.lit(k), v)]).alias("features"))


def _order_shards(spark, sf_dir):
    spark.dataSource.register(records.RecordSource)
    path = scratch.new_path(spark, "shards")
    # a shard for each task of the join, so their number grows with the rows
    _order_records(spark, sf_dir).write.format("feature_records").mode("append").save(path)
    return spark.read.format("feature_records").option("path", path).option("verify", "true").load()


@query("SELECT l_orderkey AS episode_id, count(*) AS nodes, CAST(sum(l_partkey % 1000) AS BIGINT) AS ids, CAST(sum(100 * l_linenumber + 90) AS BIGINT) AS bottoms, string_agg('Line é ' || l_linenumber, ',' ORDER BY l_linenumber) AS texts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def shards_written_and_decoded(spark, sf_dir):
    """Records with checksums written as compressed shards, read back, and their forests decoded."""
    rows = _order_shards(spark, sf_dir).select(F.get(F.col("features")["episode_id"]["int64_list"], F.lit(0)).alias("episode_id"), F.get(records.decoded_forests(F.col("features")["accessibility_trees"]["bytes_list"]), F.lit(0)).alias("n"))
    total = lambda f: F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + f(x))
    return rows.select("episode_id", F.size("n").cast("long").alias("nodes"), total(lambda x: x["unique_id"]).alias("ids"), total(lambda x: x["bounds"]["bottom"]).alias("bottoms"), F.array_join(F.transform("n", lambda x: x["text"]), ",").alias("texts"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(id) AS id FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY (100 * l_linenumber + 90) / 1000.0::DOUBLE - 100 * l_linenumber / 1000.0::DOUBLE, l_linenumber) AS id FROM lineitem) GROUP BY ALL)
SELECT o_orderkey AS episode_id, 'Order ' || o_orderkey AS goal, CAST(l.id AS INTEGER) AS element_id, CASE WHEN l.id IS NULL THEN 'tap_no_match' END AS drop_reason
FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey AND l.l_linenumber = o_custkey % 9 WHERE o_orderkey IN (SELECT l_orderkey FROM l)""")
def shards_to_native_steps(spark, sf_dir):
    """From compressed binary shards to element targets."""
    found = steps.native(steps.explode_binary(steps.from_features(_order_shards(spark, sf_dir))))
    return found.select("episode_id", "goal", F.col("action.element_id").alias("element_id"), "drop_reason")


# Targets of taps made from orders: most are in order; some lack digits behind, have other digits at the end, lie outside, or are no taps.
_TARGETS = """
WITH t AS (SELECT o_orderkey, printf('%.4f', o_custkey % 1000 / 1000.0::DOUBLE) AS x, printf('%.3f', o_orderkey % 997 / 997.0::DOUBLE) AS y FROM orders),
g AS (SELECT o_orderkey, x, y, CASE WHEN o_orderkey % 11 = 0 THEN '{"action": "scroll", "x": ' || x || ', "y": ' || y || '}' WHEN o_orderkey % 13 = 0 THEN '{"action": "tap", "x": 1' || x || ', "y": ' || y || '}'
  WHEN o_orderkey % 17 = 0 THEN '{"action": "tap", "x": ' || x || ', "y": ' || y || ', "app": "v2"}' WHEN o_orderkey % 19 = 0 THEN '{broken' ELSE '{"action": "tap", "x": ' || x || ', "y": ' || y || '}' END AS target FROM t)
"""


def _targets(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    x, y = F.format_string("%.4f", F.col("o_custkey").cast("long") % 1000 / F.lit(1000.0)), F.format_string("%.3f", k % 997 / F.lit(997.0))
    said = lambda action, a, more="": F.concat(F.lit(f'{{"action": "{action}", "x": '), a, F.lit(', "y": '), y, F.lit(more + "}"))
    target = F.when(k % 11 == 0, said("scroll", x)).when(k % 13 == 0, said("tap", F.concat(F.lit("1"), x))).when(k % 17 == 0, said("tap", x, ', "app": "v2"')).when(k % 19 == 0, "{broken").otherwise(said("tap", x))
    return table(spark, sf_dir, "orders").select(k.alias("o_orderkey"), target.alias("target"))


@query(_TARGETS + """SELECT o_orderkey, o_orderkey % 17 <> 0 AS found, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN o_orderkey % 17 <> 0 THEN '24,26,27,28,29' END AS x_at, CASE WHEN o_orderkey % 17 <> 0 THEN '37,39,40,41' END AS y_at
FROM g WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 17 = 0 OR o_orderkey % 19 <> 0)""")
def coordinate_digits(spark, sf_dir):
    """Where the digits of x and y stand in the targets of taps."""
    rows = quality.with_coordinates(_targets(spark, sf_dir)).where("places IS NOT NULL")
    return rows.select("o_orderkey", "places.found", "places.x", "places.y", F.array_join("places.x_at", ",").alias("x_at"), F.array_join("places.y_at", ",").alias("y_at"))


@query(_TARGETS + """SELECT count(*) AS rows, count(*) FILTER (tap) AS taps, count(*) FILTER (tap AND o_orderkey % 17 = 0) AS skipped FROM (SELECT *, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 17 = 0 OR o_orderkey % 19 <> 0) AS tap FROM g)""")
def coordinates_written(spark, sf_dir):
    """Counters of the write, which is below the share of skipped taps that fails it."""
    found = quality.write_coordinates(quality.with_coordinates(_targets(spark, sf_dir)), scratch.new_path(spark, "coordinates"))
    return spark.createDataFrame([(found["rows"], found["taps"], found["skipped"])], "rows long, taps long, skipped long")


@query("SELECT CAST(300 * (event_id % 5) AS INTEGER) AS step, CASE event_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'fulltest' WHEN 3 THEN 'val' ELSE 'test' END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def checkpoints_read_off_names(spark, sf_dir):
    """Files of several checkpoints and kinds, whose names say which."""
    base, rows = scratch.new_path(spark, "evaluations"), table(spark, sf_dir, "events").select("event_id")
    for i, name in enumerate(("runA_ckpt0.json", "runA_val_ckpt300.json", "runB_fulltest_ckpt600.json", "runB_val_ckpt900_native.json", "runA_ckpt1200.json")):
        files.write_document(rows.where(f"event_id % 5 = {i}"), f"{base}/{name}")
    found = files.with_file(spark.read.schema("event_id BIGINT").json(base))
    return found.groupBy("step", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_BOXES} SELECT c_custkey, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CAST((id - 1) % 8 AS INTEGER) AS colour FROM customer LEFT JOIN e ON c_nationkey = s_nationkey AND id = c_custkey % 12")
def mark_centre(spark, sf_dir):
    """The centre and colour of the mark that a prediction names."""
    rows = table(spark, sf_dir, "customer").join(_screens(spark, sf_dir), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    marks, wanted = elements.marks(F.col("nodes")), (F.col("c_custkey") % 12).cast("int")
    at = elements.resolved(marks, wanted)
    return rows.select("c_custkey", at["x"].alias("cx"), at["y"].alias("cy"), elements.by_id(marks, wanted)["colour"].alias("colour"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k <= 2")
def dry_run_rows(spark, sf_dir):
    """The first two rows of each class, to look a transformation over before it runs."""
    return sampling.first_of_each(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 2).select("event_type", "event_id", "value")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{"action": "tap", "x": ' || o_custkey || '}' WHEN 1 THEN '{"action": "wait"}' WHEN 5 THEN '{"action":"tap"}' END AS found FROM orders""")
def flat_json_from_text(spark, sf_dir):
    """The shortest object in what a model said: with prose and line ends around, two objects, a nested one that is cut, one without action, and one that is broken."""
    k = F.col("o_orderkey") % 6
    tap = F.concat(F.lit('{"action": "tap", "x": '), F.col("o_custkey").cast("string"), F.lit("}"))
    said = F.when(k == 0, F.concat(F.lit("I tap:\n```json\n"), tap, F.lit("\n``` done"))).when(k == 1, F.concat(F.lit('{"action": "wait"} then '), tap)).when(k == 2, F.lit('{"action": "tap", "at": {"x": 1}}'))
    said = said.when(k == 3, F.lit('{"type": "tap"}')).when(k == 4, F.lit('{"action": tap}')).otherwise(F.lit('}} {"action":"tap"}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.first_json_flat(said).alias("found"))


@query("SELECT * FROM (VALUES ('written', true), ('shuffled', false)) t(copy, sorted)")
def order_in_split_files(spark, sf_dir):
    """Whether files hold their rows in order: those of the writer, and those of a shuffled copy, which must not pass. Neighbours are compared, so no file is held together."""
    rows, path, other = _routed(spark, sf_dir), scratch.new_path(spark, "steps"), scratch.new_path(spark, "shuffled")
    files.write_steps(rows, path)
    rows.repartition(2).sortWithinPartitions(F.xxhash64("episode_id", "step_index")).write.parquet(other)
    return files.sorted_files(spark, path).select(F.lit("written").alias("copy"), "sorted").unionByName(files.sorted_files(spark, other).select(F.lit("shuffled").alias("copy"), "sorted"))
