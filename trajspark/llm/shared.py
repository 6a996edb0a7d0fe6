"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path

#: Rows and bytes of an Arrow batch. Documents are long, so the default of 10,000 rows would make batches of many MB.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "500"), "spark.sql.execution.arrow.maxBytesPerBatch": (str(2**31 - 1), str(4 << 20))}
#: Columns that an operator adds for itself start so.
OWN = "_trajspark_"


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own setting."""
    for key, (default, small) in ARROW.items():
        if spark.conf.get(key, default) in (default, f"{default}b"):
            spark.conf.set(key, small)


#: Spark deletes the shuffle files of an action once it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, and survives lost executors. Shuffle files of the write go with it."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was) if was is not None else conf.unset(CLEANUP)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.settled = path
    return found


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, whatever is still to run."""
    for df in settled:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NAMELESS = f"{OWN}nameless"


def named(docs: DataFrame) -> DataFrame:
    """The documents with a doc_id each, and whether it was null (NAMELESS): then a hash of the text stands in, so rows without id are told apart by text."""
    stand_in = F.xxhash64(F.lit("nameless"), F.col("text").cast("string"))
    return docs.withColumns({NAMELESS: F.col("doc_id").isNull(), "doc_id": F.coalesce(F.col("doc_id").cast("long"), stand_in)})


KEY = f"{OWN}key"


def with_key(docs: DataFrame) -> DataFrame:
    """The rows with KEY, a hash of doc_id and text: rows that differ in either are told apart by it, whatever ids are null or repeated."""
    i, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.withColumn(KEY, F.xxhash64(F.lit("row"), i, t, i.isNull(), t.isNull()))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and KEY."""
    return with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def as_named(docs: DataFrame, like: DataFrame) -> DataFrame:
    """What is left of named(like), with the columns of `like`."""
    return docs.withColumn("doc_id", F.when(~F.col(NAMELESS), F.col("doc_id")).cast(like.schema["doc_id"].dataType)).select(*[F.col(f"`{c}`") for c in like.columns])


#: Bits of a bitmap: 16 for each key, within these bounds (128 KB and 32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_BITS_PER_ROW = 32768


def may_contain(rows: DataFrame, key: str, wanted: DataFrame, others: bool = False, keys: int | None = None) -> DataFrame:
    """The rows whose key may be in `wanted` (a table with a column of that name). `others`: the rest instead.

    A bitmap of at most MOST_BITS bits is broadcast, sized by the number of keys (`keys`, if known). Rows outside `wanted` can pass, so an exact join has to
    follow; rows in `wanted` always pass. With over 100 million keys more and more of the others pass too, and the join alone decides.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * (wanted.count() if keys is None else keys)).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    group, map_ = f"{OWN}group", f"{OWN}map"
    maps = (
        wanted.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / _BITS_PER_ROW).alias(group))
        .agg(F.call_function("bitmap_construct_agg", F.col("slot") % _BITS_PER_ROW).alias(map_))
    )
    byte = F.conv(F.hex(F.substring(map_, F.floor((slot % _BITS_PER_ROW) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("getbit", byte, (slot % 8).cast("int")) == 1
    return rows.join(F.broadcast(maps), F.floor(slot / _BITS_PER_ROW) == F.col(group), "left").where(F.coalesce(bit, F.lit(False)) != F.lit(others)).select(*[F.col(f"`{c}`") for c in rows.columns])


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not in `dropped`; only rows that may be dropped are shuffled."""
    dropped = settle(dropped.select(key).distinct(), "dropped")
    keys, columns = dropped.count(), [F.col(f"`{c}`") for c in rows.columns]
    return may_contain(rows, key, dropped, others=True, keys=keys).unionByName(may_contain(rows, key, dropped, keys=keys).join(dropped, key, "left_anti").select(*columns))


def recurring(rows: DataFrame, key: str, name: str, *more, made: list | None = None) -> DataFrame:
    """`rows` restricted to keys that occur more than once, with how often (`times`) and the further aggregates of each key.

    Counts are combined before the shuffle. Keys that hold over a thousandth of what is counted are at most a
    thousand; they are broadcast, and their rows never shuffled by key. The rest has no heavy key left.
    """
    times = settle(rows.groupBy(key).agg(F.count("*").alias("times"), *more).where("times > 1"), name)
    if made is not None:  # for whoever discards it
        made.append(times)
    all_ = times.agg(F.sum("times")).first()[0] or 0
    heavy, light = times.where(F.col("times") > all_ / 1000), times.where(F.col("times") <= all_ / 1000)
    return rows.join(F.broadcast(heavy), key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key))


def heavy_keys(rows: DataFrame, key: str, most: int = 1000) -> list:
    """The `most` most frequent values of `key` among those with over 100 rows; what is left has no key with over a `most`-th of the rows."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 100")
    return [r[0] for r in counts.orderBy(F.desc("n"), key).limit(most).select(key).collect()]


def matched(rows: DataFrame, key: str, other: DataFrame, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """rows joined with `other`, which has each value of `key` once. What `other` has for heavy keys is broadcast, so no key's rows meet in one task."""
    heavy = heavy_keys(rows, key) if heavy is None else heavy
    if not heavy:
        return rows.join(other, key, how)
    some = F.col(key).isin(heavy)
    light = rows.where(~F.coalesce(some, F.lit(False))).join(other.where(~some), key, how)
    return light.unionByName(rows.where(some).join(F.broadcast(other.where(some)), key, how))


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): label is the least node that it can reach.

    Alternating rounds: every node hands the least label around it to its neighbours, then labels
    are followed one step (pointer jumping). Each round is written to the shared folder. The number
    of rounds grows with the logarithm of the longest chain, and nothing is collected but a flag. Nodes with
    very many edges, and labels of very many nodes, are joined by broadcast (see `matched`).
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    hubs = heavy_keys(both, "b")
    while True:
        around = matched(both, "b", labels.select(F.col("node").alias("b"), F.col("label").alias("other")), heavy=hubs).groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        near = settle(labels.join(around, "node", "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("other", "label")).alias("label")), f"{name}-around")
        step = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = settle(matched(near, "label", step, "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), f"{name}-labels")
        discard(labels, near)
        if new.where("was <> label").isEmpty():
            discard(both)
            out = new.select("node", "label")
            out.settled = new.settled
            return out
        labels = new
