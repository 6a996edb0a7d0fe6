"""Idempotent appends: a micro-batch that is retried replaces what it wrote, so a stream that stops anywhere and starts again writes every row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def batch_writer(path: str):
    """For foreachBatch: writes each batch to its own folder, so a batch that is retried, with whatever rows (none, too), replaces what it wrote before."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def append_stream(rows: DataFrame, path: str, checkpoint: str, after: Callable[[int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Start writing a stream under `path`, or go on where it stopped: Spark's log in `checkpoint` says which batch is open, and that batch is written again.

    `after` is called with the number of a batch that was written and isn't committed yet; what it raises stops the stream there.
    Without `available_now` the stream waits for more. One path belongs to one checkpoint.
    """
    write = batch_writer(path)

    def write_batch(batch_rows: DataFrame, batch: int) -> None:
        write(batch_rows, batch)
        if after:
            after(batch)

    out = rows.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that batches have written so far."""
    return spark.read.schema(f"{schema}, batch BIGINT").parquet(path).drop("batch")
