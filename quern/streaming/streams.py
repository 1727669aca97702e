"""Incremental runs on files that keep arriving."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quern.core import col
from quern.operators.validate import RuleSet, row_error

WATERMARK = "1 hour"


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int | None = None, **options) -> DataFrame:
    """Files of a folder in the order of their arrival."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def finish(query: StreamingQuery) -> None:
    """Wait until everything that had arrived is processed, and raise what failed."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def append_all(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, fmt: str = "parquet") -> None:
    """Transform what has arrived since the last run, batch after batch, into append-only files.

    The checkpoint remembers the files already taken, so a repeated run adds nothing twice.
    """
    writer = transform(stream).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    finish(writer.trigger(availableNow=True).start(out))


def poll(stream: DataFrame, on_data: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "1 second", max_batches: int | None = None, idle_seconds: float = 10.0) -> int:
    """Look for new files at an interval and hand every batch to a callback.

    Stops after `max_batches` batches, or when nothing new came for `idle_seconds`. Returns the
    number of batches handled. A batch that starts beyond the limit fails, so it is not committed
    and the next run takes it.
    """
    handled: list[int] = []
    refused: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        if max_batches is not None and len(handled) >= max_batches:
            refused.append(number)
            raise RuntimeError(f"batch {number} is left to the next run")
        on_data(batch, number)
        handled.append(number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    seen, since = -1, time.monotonic()
    while query.isActive and (max_batches is None or len(handled) < max_batches) and time.monotonic() - since < idle_seconds:
        if len(handled) != seen:
            seen, since = len(handled), time.monotonic()
        query.awaitTermination(0.2)
    query.stop()
    if query.exception() and not refused:
        raise query.exception()
    return len(handled)


def windowed_means(stream: DataFrame, ts: str, value: str, keys: list[str], window: str = "1 hour", delay: str = WATERMARK) -> DataFrame:
    """Mean and count per time window and key; a window closes when the watermark has passed it,
    and rows that arrive later than `delay` are dropped."""
    marked = stream.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, delay)
    out = marked.groupBy(F.window(col(ts), window), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("rows"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "mean", "rows")


def end_of_input(spark: SparkSession, path: str, schema: T.StructType | str, ts: str, window: str = "1 hour", delay: str = WATERMARK, fmt: str = "parquet") -> None:
    """Let the next run close the windows that are still open: nothing more will arrive.

    Lands one row without values, a window and a delay after the newest time, so the watermark passes every window of
    real rows. Its own window stays open and is never written. Rows that arrive later count as late. Call it once.
    """
    landed = spark.read.schema(schema).format(fmt).load(path)
    newest = landed.agg(F.max(col(ts).cast("timestamp")).alias("_newest")).where("_newest is not null")
    after = F.col("_newest") + F.expr(f"interval {window}") + F.expr(f"interval {delay}")
    marker = newest.select(*[(after if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in landed.schema.fields])
    marker.write.format(fmt).mode("append").save(path)


def validate_on_arrival(stream: DataFrame, rules: RuleSet, good: str, bad: str, checkpoint: str) -> None:
    """Valid rows to one folder, failing rows with their first error to another.

    Each batch overwrites its own sub-folder, so a batch that is repeated after a failure
    leaves no duplicates. The batch is checked once per sink without being cached.
    """

    def each(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("error", row_error(batch, rules))
        checked.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={number}")
        checked.where("error is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")

    finish(stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def drop_repeats(stream: DataFrame, ts: str, keys: list[str], delay: str = WATERMARK) -> DataFrame:
    """First arrival of each key within the watermark; the state forgets older keys."""
    marked = stream.withColumn(ts, col(ts).cast("timestamp")).withWatermark(ts, delay)
    return marked.dropDuplicatesWithinWatermark(keys)
