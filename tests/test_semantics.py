"""Published arithmetic, hand-made rows, and the differences between look-alikes."""

import gzip

import pytest
from pyspark.sql import functions as F

from trajspark.functions import actions, geometry, text
from trajspark.operators import agentruns, compare, elements, match, metrics, quality, spatial, steps, weights
from trajspark.sources import files, records


def one(df):
    return df.collect()[0]


def test_class_weights_golden(spark):
    n = [44, 266, 4936, 9202, 9290, 9728, 17664, 24452, 83500]
    got = weights.class_weights(spark.createDataFrame(list(enumerate(n)), "label long, n long")).orderBy("label").collect()
    assert [round(r.weight, 4) for r in got] == [5.0715, 5.0715, 2.3864, 1.7478, 1.7395, 1.6999, 1.2615, 1.0722, 0.5802]
    assert abs(sum(r.weight * r.n for r in got) / sum(n) - 1) < 1e-12


def test_buckets_golden(spark):
    parts = [("both_right", 66), ("regression", 78), ("gain", 27), ("both_wrong", 329)]
    df = spark.createDataFrame([(c,) for c, k in parts for _ in range(k)], "category string")
    r = one(compare.full_match(df))
    assert (round(r.a, 3), round(r.b, 3), r.net) == (0.288, 0.186, -51)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "v double")
    assert one(spatial.quantiles(df, "v", (0.5,))).value == 3.0


def test_place_values(spark):
    df = spark.createDataFrame([("0.293",), ("0.5",)], "v string").select(text.place_values(F.col("v")).alias("p"))
    assert [r.p for r in df.collect()] == [[1.0, 0.1, 0.01, 0.001], [1.0, 0.1]]


RAW = [
    ('{"action":"wait"}', True, True), ('```json {"action":"wait"} ```', True, True), ('{"action_type":"tap","action_args":{"element_id":7}}', True, False),
    ('} {"action":"wait"}', False, True), ('{bad} {"action":"wait"}', True, False), ("{}", False, False), ("no json", False, False), (None, False, False),
]


def test_extractors_differ(spark):
    df = spark.createDataFrame([(r[0],) for r in RAW], "v string").select(text.first_json_balanced(F.col("v")).alias("b"), text.first_json_flat(F.col("v")).alias("f"))
    assert [(r.b is not None, r.f is not None) for r in df.collect()] == [(b, f) for _, b, f in RAW]


def pair(spark, pred, gt, mode, at=None, xy=None):
    s = spark.range(1).select(actions.action(**{k: F.lit(v) for k, v in pred.items()}).alias("p"), actions.action(**{k: F.lit(v) for k, v in gt.items()}).alias("g"))
    point = lambda v: F.struct(F.lit(v[0]).cast("double").alias("x"), F.lit(v[1]).cast("double").alias("y"))
    more = {"at": point(at or (None, None)), "xy": point(xy or (None, None))} if mode in ("native", "mark") else {}
    return one(s.select(match.match(F.col("p"), F.col("g"), mode, **more).alias("m"))).m


MATRIX = [
    ({"action": "long_press"}, {"action": "long_press", "x": 0.1, "y": 0.1}, "coordinate", True), ({"action": "long_press"}, {"action": "long_press", "x": 0.1, "y": 0.1}, "restratified", False),
    ({"action": "fly"}, {"action": "fly"}, "coordinate", True), ({"action": "fly"}, {"action": "fly"}, "restratified", False), ({"action": "fly"}, {"action": "fly"}, "native", True),
    ({"action": "WAIT"}, {"action": "wait"}, "coordinate", False), ({"action": "WAIT"}, {"action": "wait"}, "element", True),
    ({"action": "scroll_down"}, {"action": "scroll", "direction": "down"}, "native", True), ({"action": "scroll down"}, {"action": "scroll", "direction": "down"}, "mark", False),
    ({"action": "scroll", "direction": "Up"}, {"action": "scroll", "direction": "up"}, "coordinate", False), ({"action": "scroll", "direction": "Up"}, {"action": "scroll", "direction": "up"}, "restratified", True),
    ({"action": "scroll"}, {"action": "scroll"}, "coordinate", True), ({"action": "type", "text": " a\n"}, {"action": "type", "text": "a"}, "native", True),
    ({"action": "tap", "element_id": 3}, {"action": "tap", "element_id": 3}, "element", True), ({"action": "tap"}, {"action": "tap", "element_id": 3}, "element", False), ({}, {"action": "wait"}, "native", False),
]


@pytest.mark.parametrize("pred,gt,mode,want", MATRIX)
def test_match_matrix(spark, pred, gt, mode, want):
    assert pair(spark, pred, gt, mode) is want


def test_press_by_point(spark):
    assert pair(spark, {"action": "tap"}, {"action": "tap"}, "native", at=(0.5, 0.5), xy=(0.5, 0.6)) is True
    assert pair(spark, {"action": "tap"}, {"action": "tap"}, "native", at=(0.5, 0.5), xy=(0.5, 0.9)) is False
    assert pair(spark, {"action": "tap"}, {"action": "tap"}, "mark", at=(0.5, 0.5)) is False


def node(click, depth, box, label):
    return (0, box, label, None, None, None, click, False, False, depth)


def test_native_targets(spark):
    from trajspark import schemas

    a, b = node(True, 2, [0.4, 0.4, 0.6, 0.6], "Send"), node(False, 3, [0.45, 0.45, 0.55, 0.55], "Send")
    tap = lambda x, y: ("tap", x, y, None, None, None, None, None)
    rows = [(7, 0, [a, b], 1000, 1000, tap(0.5, 0.5)), (7, 1, [a], 1000, 1000, tap(0.9, 0.9)), (7, 2, [a], 1000, 1000, ("scroll", None, None, None, None, None, None, "down")), (8, 0, [], 1000, 1000, tap(0.5, 0.5)), (8, 1, [node(True, 0, [0.4, 0.4, 0.41, 0.6], "x")], 1000, 1000, tap(0.5, 0.5))]
    df = spark.createDataFrame(rows, f"episode_id long, step_index int, a11y array<struct<{schemas.NODE}>>, image_w int, image_h int, action struct<{schemas.ACTION}>")
    got = {(r.episode_id, r.step_index): (r.action.element_id, r.drop_reason) for r in steps.native(df).collect()}
    assert got == {(7, 0): (1, None), (7, 1): (None, "tap_no_match"), (7, 2): (None, None), (8, 0): (None, "no_a11y"), (8, 1): (None, "empty")}


def test_prior_and_schemas(spark):
    base = f"Task: t\n\n{text.SCHEMA_V1}\n\nElements:\n  1: a"
    rows = [(1, 0, "wait"), (1, 2, "tap"), (1, 3, "wait"), (2, 2, "wait")]
    df = spark.createDataFrame(rows, "episode_id long, step_index int, a string").select("episode_id", "step_index", F.lit(base).alias("prompt"), actions.action(action=F.col("a"), element_id=F.when(F.col("a") == "tap", 7)).alias("action"))
    out = {(r.episode_id, r.step_index): r for r in steps.to_v3(steps.to_v2(df)).collect()}
    assert [out[k].prior_kind for k in sorted(out)] == ["step0", "nearest_earlier", "immediate", "orphan"]
    assert "Previous action: <none>\n\nBelow is a list" in out[1, 0].prompt and 'Previous action: {"action_type": "tap", "action_args": {"element_id": 7}}\n\nBelow' in out[1, 3].prompt
    assert text.SCHEMA_V2 in out[1, 0].prompt
    bad = df.select(actions.to_json_v2(actions.action(action=F.lit("done"))).alias("j"))
    with pytest.raises(Exception, match="unknown action type"):
        bad.collect()


def test_flatten_both_schemas(spark):
    said = ['{"action": "tap", "element_id": 7}', '{"action_type": "tap", "action_args": {"element_id": 7}}', "[1]", "x"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(actions.from_json_text(F.col("s")).alias("a")).collect()
    assert [(r.a.action, r.a.element_id) if r.a else None for r in got] == [("tap", 7), ("tap", 7), None, None]


def test_explode_mirror(spark):
    from trajspark import schemas

    act = lambda t, **k: (t, k.get("app"), k.get("d"), k.get("text"), k.get("x"), k.get("y"))
    rows = [(1, "goal", [("a", 10, 10), ("b", 10, 10)], [act("click", x=50.0, y=5.0)], []), (2, "goal", [], [], []), (3, "g", [("a", 10, 10)], [act("long_press", x=1.0, y=1.0)], ["do"])]
    got = sorted((r.episode_id, r.step_index, r.total_steps, r.granularity, r.instruction, r.action.action, r.action.x) for r in steps.explode_steps(spark.createDataFrame(rows, schemas.EPISODE)).collect())
    assert got == [(1, 0, 1, "goal", "goal", "tap", 1.0), (1, 0, 1, "step_instruction", "goal", "tap", 1.0), (1, 1, 2, "goal", "goal", "done", None), (1, 1, 2, "step_instruction", "goal", "done", None), (3, 0, 1, "goal", "g", "long_press", None), (3, 0, 1, "step_instruction", "do", "long_press", None)]


def test_failures_in_order(spark):
    from trajspark import schemas

    done = lambda out, *said: (out, list(said))
    cases = {
        "runtime_exception": (0.0, "boom", done(["x"])), "no_steps": (0.0, None, done([])), "model_gave_up_infeasible": (0.0, None, done(["x"], ("status", "infeasible"))), "model_thought_complete_but_wrong": (0.0, None, done(["x"], ("status", "complete"))),
        "answered_but_wrong": (0.0, None, done(["x"], ("answer", None))), "parse_fail_majority": (0.0, None, done(["x", "Action: {}"], ("tap", None))), "max_steps_no_terminate": (0.0, None, done(["Action: {}"] * 3, ("tap", None))),
    }
    df = spark.createDataFrame([(k, s, e, 1.0, 1, d) for k, (s, e, d) in cases.items()] + [("ok", 1.0, None, 1.0, 1, ([], []))], schemas.AGENT_EPISODE)
    assert all(r.task_template == r.m for r in df.where("is_successful < 1").select("task_template", agentruns.failure().alias("m")).collect())
    assert one(agentruns.rollup(df)).successes == 1 and {r.n for r in agentruns.failure_modes(df).collect()} == {1}


def test_record_shards(spark, tmp_path):
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    entry = field(1, b"episode_id") + field(2, field(3, bytes([1 << 3, 42])))
    good = records.frame(field(1, field(1, entry)))
    path = tmp_path / "a.gz"
    path.write_bytes(gzip.compress(good * 2))
    spark.dataSource.register(records.RecordSource)
    rows = spark.read.format("feature_records").option("path", str(path)).load().collect()
    assert [r.features["episode_id"].int64_list for r in rows] == [[42], [42]]
    path.write_bytes(gzip.compress(good[:-6]))
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("feature_records").option("path", str(path)).load().collect()


def test_sources(spark, tmp_path):
    assert files.shard_numbers("0-3, 7,25") == [0, 1, 2, 3, 7]
    doc = spark.createDataFrame([([1, 2], [3], [2])], "train array<long>, validation array<long>, test array<long>")
    assert {(r.episode_id, r.split) for r in files.splits(doc).collect()} == {(1, "train"), (2, "test"), (3, "val")}
    (tmp_path / "runA_val_ckpt300.json").write_text('{"metrics": {"n": 1},\n "all_predictions": [{"episode_id": 1, "step_index": 0, "pred_parsed": {"action": "wait"}, "gt": {"action": "wait"}}]}')
    r = one(files.predictions(files.eval_files(spark, str(tmp_path))))
    assert (r.step, r.kind, r.pred.action) == (300, "val", "wait")
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int", tolerant=True).cache()
    assert files.good_lines(rows).count() == 1 and rows.count() == 2


def test_small_pieces(spark):
    df = spark.range(1)
    r = one(df.select(geometry.coordinate("x", F.lit("<loc_x_5>"), 10).alias("a"), geometry.coordinate("x", F.lit(" 0.5 ")).alias("b"), geometry.coordinate("x", F.lit("<loc_x_50>"), 10).alias("c"), text.cluster(F.lit("SystemWifiTurnOn")).alias("d"), text.file_name(F.lit(7), F.lit(123)).alias("e"), text.decoded(F.lit(b"a\xff")).alias("f")))
    assert tuple(r) == (0.55, 0.5, None, "SystemWifi", "00007_123.png", "a�")
    assert one(df.select(elements.short_label(F.struct(F.lit(" ").alias("text"), F.lit(None).cast("string").alias("content_description"), F.lit("id_of").alias("view_id_resource_name"), F.lit("a.B").alias("class_name"))).alias("l"))).l == "id_of"
    with pytest.raises(Exception, match="must be"):
        quality.require(df, F.col("id") > 5, "must be over 5").collect()
    assert one(metrics.rates(spark.createDataFrame([], "parsed boolean, type_ok boolean, ok boolean"))).full_match == 0.0


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    """A protobuf message of (field, bytes or int)."""
    return b"".join(number(n << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(n << 3) + number(v & (1 << 64) - 1) for n, v in parts)


def forest(*nodes):
    return message((1, message((3, 1), (11, message(*[(1, n) for n in nodes])))))


def screen_node(box, text="", click=0, visible=1, depth=1):
    return message((1, 9), (2, message(*[(i + 1, v) for i, v in enumerate(box)])), (3, b"android.widget.Button"), (7, text.encode()), (10, b"app:id/send"), (14, click), (23, visible), (27, depth))


def binary_record(episode, actions_, forests, instructions):
    lists = lambda k, values: message((k, message(*[(1, v) for v in values])))
    entry = lambda name, k, values: (1, message((1, name.encode()), (2, lists(k, values))))
    n = len(actions_)
    feats = [entry("episode_id", 3, [episode]), entry("goal", 1, ["Send é".encode()]), entry("actions", 1, actions_), entry("accessibility_trees", 1, forests), entry("step_instructions", 1, instructions), entry("screenshot_widths", 3, [1000] * n), entry("screenshot_heights", 3, [2000] * n)]
    return records.frame(message((1, message(*feats))))


def test_binary_shards_to_native_steps(spark, tmp_path):
    """Shards, forests, step rows, element targets, and both later schemas, end to end."""
    button = forest(screen_node((100, 100, 300, 300), "Send", click=1), screen_node((0, 0, 1000, 2000), "", visible=1), screen_node((-50, 0, -1, 10), "off", click=1), screen_node((1, 1, 5, 5), "tiny"))
    said = [b'{"action_type": "click", "x": 200, "y": 200}', b"{bad", b'{"action_type": "scroll", "direction": "DOWN"}']
    (tmp_path / "a.gz").write_bytes(gzip.compress(binary_record(7, said, [button, button, b"\xff\xff"], [b"tap send", b"", b"go down"])))
    (tmp_path / "b.gz").write_bytes(gzip.compress(binary_record(8, said[:1], [button], [b"tap"])))
    spark.dataSource.register(records.RecordSource)
    for path in (str(tmp_path), f"{tmp_path}/*.gz", f"file://{tmp_path}"):
        found = spark.read.format("feature_records").option("path", path).option("verify", "true").load()
        assert found.count() == 2
    rows = steps.explode_binary(steps.from_features(found)).orderBy("episode_id", "step_index").collect()
    assert [(r.episode_id, r.step_index, r.total_steps, r.goal, r.action.action, r.drop_reason) for r in rows] == [(7, 0, 3, "Send é", "tap", None), (7, 1, 3, "Send é", "wait", "bad_action"), (7, 2, 3, "Send é", "scroll", None), (8, 0, 1, "Send é", "tap", None)]
    assert [n.text for n in rows[0].a11y] == ["Send", "tiny"] and rows[0].a11y[0].bbox == [0.1, 0.05, 0.3, 0.15] and rows[0].a11y[0].view_id_resource_name == "send" and rows[2].a11y == []
    good = quality.kept(steps.explode_binary(steps.from_features(found)))
    native = steps.native(good)
    assert {(r.episode_id, r.step_index, r.drop_reason, r.action.element_id) for r in native.collect()} == {(7, 0, None, 1), (7, 2, "no_a11y", None), (8, 0, None, 1)}
    assert {r.counter: r.n for r in steps.native_counters(native).collect()} == {"tap_matched": 2, "no_a11y": 1}
    kept = quality.kept(native)
    v3 = steps.to_v3(steps.to_v2(kept.withColumn("prompt", text.element_prompt(F.col("instruction"), F.col("elements"))))).orderBy("episode_id").collect()
    assert [r.target for r in v3] == ['{"action_type": "tap", "action_args": {"element_id": 1}}'] * 2 and "Previous action: <none>" in v3[0].prompt and "  1: Send" in v3[0].prompt
    spoiled = bytearray(binary_record(7, said, [button] * 3, [b"a"] * 3))
    spoiled[40] ^= 1
    (tmp_path / "a.gz").write_bytes(gzip.compress(bytes(spoiled)))
    with pytest.raises(Exception, match="wrong checksum"):
        spark.read.format("feature_records").option("path", str(tmp_path)).option("verify", "true").load().collect()


def test_checksum_is_the_published_one():
    crc = (records.checksum(b"123456789") - 0xA282EAD8) & 0xFFFFFFFF
    assert (crc << 15 | crc >> 17) & 0xFFFFFFFF == 0xE3069283


def test_convert_agent_runs(spark, tmp_path):
    import pickle

    from trajspark.sources import convert

    run = tmp_path / "run_1"
    run.mkdir()
    episode = {"is_successful": 1.0, "exception_info": None, "run_time": 2.0, "episode_length": 3, "episode_data": {"action_output": ["x"], "action_output_json": [{"action_type": "status", "goal_status": "complete"}]}}
    (run / "SystemWifiTurnOn.pkl.gz").write_bytes(gzip.compress(pickle.dumps([episode, episode | {"task_template": "Other"}])))
    assert convert.convert(str(tmp_path), str(tmp_path / "runs.jsonl")) == 2
    assert sorted(r.task_template for r in files.agent_runs(spark, str(tmp_path)).collect()) == ["Other", "SystemWifiTurnOn"]
    (run / "bad.pkl.gz").write_bytes(gzip.compress(pickle.dumps([{"x": gzip.GzipFile}])))
    with pytest.raises(pickle.UnpicklingError):
        convert.convert(str(tmp_path), str(tmp_path / "again.jsonl"))


def test_quantiles_and_running_over_ranges(spark):
    """Ranges of values don't change what one ordered window gives, ties and nulls included."""
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 40)), rng.random() < 0.5 if rng.random() < 0.9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, run string, v double, ok boolean")
    for by in ([], ["run"]):
        got = {(tuple(r[k] for k in by), r.p): r.value for r in spatial.quantiles(df, "v", (0.0, 0.5, 0.95, 1.0), by).collect()}
        for group in [()] if not by else [("a",), ("b",)]:
            v = sorted(r[2] for r in rows if not group or r[1] == group[0])
            assert all(got[group, p] == v[min(len(v) - 1, int(len(v) * p))] for p in (0.0, 0.5, 0.95, 1.0))
    got = {(r.run, r.n): r.accuracy for r in metrics.running(df, "i", 10).collect()}
    for run in "ab":
        own = [r[3] for r in rows if r[1] == run]
        for n in range(10, len(own) + 1, 10):
            known = [x for x in own[:n] if x is not None]
            assert abs(got[run, n] - sum(known) / len(known)) < 1e-12
