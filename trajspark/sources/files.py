"""Readers: JSON lines, evaluation files, splits, flags, checkpoints; and the sorted writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def json_lines(spark: SparkSession, path: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """Rows of JSON lines. A bad line is an error; if tolerant, a row with only _corrupt_record set (filter and count those)."""
    if tolerant:
        return spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def episodes(spark: SparkSession, path: str, schema: str = schemas.EPISODE, splits: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Episode tables partitioned by `split`, with the split as a column: of some splits only (others aren't read), or lazily the first `limit` rows."""
    rows = spark.read.schema(f"{schema}, split STRING").parquet(path)
    rows = rows.where(F.col("split").isin(splits)) if splits else rows
    return rows.limit(limit) if limit else rows


def agent_runs(spark: SparkSession, path: str) -> DataFrame:
    """Agent episodes as JSON lines (see `convert`), from a folder or, if it holds none, from its first `run_*` folder by name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    names = sorted((f.getPath().getName(), f.isDirectory()) for f in folder.getFileSystem(conf).listStatus(folder))
    runs = [n for n, inner in names if inner and n.startswith("run_")]
    if runs and not any(n.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")) for n, _ in names):
        path = f"{path.rstrip('/')}/{runs[0]}"
    return spark.read.schema(schemas.AGENT_EPISODE).option("mode", "FAILFAST").option("pathGlobFilter", "*.json*").json(path)


def good_lines(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def with_file(rows: DataFrame) -> DataFrame:
    """Add file, step (the number after `ckpt`, else null) and kind (val, fulltest or test), read off the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    kind = F.when(F.contains(name, F.lit("_val_")), "val").when(F.contains(name, F.lit("_fulltest")), "fulltest").otherwise("test")
    return rows.select("*", name.alias("file"), F.regexp_extract(name, r"ckpt(\d+)", 1).try_cast("int").alias("step"), kind.alias("kind"))


def eval_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole-document evaluation files: file, step, kind, metrics, all_predictions."""
    return with_file(spark.read.schema(schemas.EVAL_FILE).option("multiLine", True).json(path))


def predictions(files: DataFrame) -> DataFrame:
    """A row a prediction in one schema: `pred` whichever name the file has it under, its place in the file as position."""
    rows = files.select("file", "step", "kind", F.posexplode("all_predictions").alias("position", "p")).select("file", "step", "kind", "position", "p.*")
    fields = ["action", "x", "y", "element_id", "mark", "text", "app_name", "direction"]
    either = F.struct(*[F.coalesce(F.col("pred")[f], F.col("pred_parsed")[f]).alias(f) for f in fields])
    at = F.struct(F.col("pred._resolved_x").alias("x"), F.col("pred._resolved_y").alias("y"))
    return rows.withColumn("at", at).withColumn("pred", F.when(F.col("pred").isNotNull() | F.col("pred_parsed").isNotNull(), either)).drop("pred_parsed")


def splits(document: DataFrame) -> DataFrame:
    """episode_id, split from {split: [ids]}; `validation` is called val; an id in several splits belongs to the last in the document."""
    pairs = document.select(F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit("val" if s == "validation" else s).alias("split"), F.col(s).alias("ids")) for i, s in enumerate(document.columns)])).alias("s"))
    rows = pairs.select(F.col("s.o").alias("o"), "s.split", F.explode("s.ids").alias("episode_id"))
    return rows.groupBy("episode_id").agg(F.max_by("split", "o").alias("split"))


def flag_maps(document: DataFrame) -> DataFrame:
    """episode_id and a map of the splits that list it."""
    pairs = document.select(F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in document.columns])).alias("s"))
    rows = pairs.select("s.split", F.explode("s.ids").alias("episode_id")).distinct()
    return rows.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.lit(True))))).alias("flags"))


def flag_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """episode_id (or id) with boolean flags, false where absent; rows without an id go."""
    have = [c for c in ("episode_id", "id") if c in rows.columns]
    flag = [F.coalesce(F.col(n), F.lit(False)).alias(n) if n in rows.columns else F.lit(False).alias(n) for n in names]
    return rows.select(F.coalesce(*map(F.col, have)).alias("episode_id"), *flag).where("episode_id IS NOT NULL")


def first_found(*frames: DataFrame) -> DataFrame:
    """The first that has a row."""
    return next((f for f in frames if not f.isEmpty()), frames[-1])


def shard_numbers(spec: str, total: int = 20) -> list[int]:
    """'0-3,7' as sorted numbers under `total`."""
    bounds = [p.strip().partition("-") for p in spec.split(",")]
    every = (range(int(a), int(b if dash else a) + 1) for a, dash, b in bounds)
    return sorted({n for r in every for n in r if 0 <= n < total})


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those paths that exist, on any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    as_path = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, x in zip(paths, as_path) if x.getFileSystem(conf).exists(x)]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def prefix(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order that is named, not a file's."""
    return rows.orderBy(*order).limit(n)


def write_steps(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Rows sorted by episode, step and granularity, in a folder for each split."""
    keys = ["episode_id", "step_index", "granularity"]
    rows.repartitionByRange("split", *keys).sortWithinPartitions("split", *keys).write.partitionBy("split").format(form).save(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small table as one JSON-lines file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_document(rows: DataFrame, path: str) -> None:
    """A table as one JSON-lines file of that very name; an existing one is replaced only once the new one is whole. For results that one task can write."""
    spark = rows.sparkSession
    jvm, part = spark.sparkContext._jvm, f"{path}.unfinished"
    rows.coalesce(1).write.mode("overwrite").json(part)
    at, to = jvm.org.apache.hadoop.fs.Path(part), jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = next(f.getPath() for f in where.listStatus(at) if f.getPath().getName().startswith("part-"))
    where.delete(to, True)
    where.rename(written, to)
    where.delete(at, True)


def sorted_files(spark: SparkSession, path: str) -> DataFrame:
    """sorted: whether every file under `path` holds its rows in the order of episode and step. Each row is held against the next one by its number in the file, in a join that spreads files over tasks (and is hinted to: sorted files are so small for their rows that the planner would broadcast them)."""
    rows = spark.read.parquet(path).select(F.struct("episode_id", "step_index").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    next_ = rows.select(F.col("key").alias("next"), "file", (F.col("at") - 1).alias("at"))
    return rows.hint("merge").join(next_, ["file", "at"]).agg(F.coalesce(F.bool_and(F.col("key") <= F.col("next")), F.lit(True)).alias("sorted"))


def rewrite(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as JSON lines in the order of the input, which `order` names."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Add a run's results to a log of JSON lines."""
    rows.coalesce(1).write.mode("append").json(path)


def copied(spark: SparkSession, source: str, target: str) -> None:
    """A copy of a file or folder on any file system Spark reads; the target must not exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if b.getFileSystem(conf).exists(b):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def merged(frames: list[DataFrame], path: str, form: str = "parquet") -> None:
    """Partial results of several workers as one sorted table; what stood at `path` before is replaced."""
    keys = ["episode_id", "step_index", "granularity"]
    rows = union(frames)
    rows.repartitionByRange("split", *keys).sortWithinPartitions("split", *keys).write.mode("overwrite").partitionBy("split").format(form).save(path)
