"""Structured Streaming forms of ingestion, bucketing, de-duplication and retention.

Offsets and state are in the stream's checkpoint, so a restart goes on where it
stopped.  Watermarks bound all state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from murmuration.operators.keyed import KeyedTable


def read_rows(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New JSON or Parquet files of a folder as a stream, `files` a batch."""
    kind = "json" if "json" in path.rsplit("/", 1)[-1] else "parquet"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def buckets(stream: DataFrame, at: str = "ts", width: str = "1 hour", late: str = "2 hours", value: str = "value", key: str = "event_type") -> DataFrame:
    """(start, key, n, total) per window; later rows than the watermark are dropped."""
    grouped = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w")["start"].alias("start"), key, "n", "total")


def sliding(stream: DataFrame, at: str = "ts", width: str = "1 day", slide: str = "6 hours", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w")["start"].alias("start"), "n")


def sessions(stream: DataFrame, at: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    grouped = stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w")["start"].alias("start"), F.col("w")["end"].alias("end"), "n")


def first_copies(stream: DataFrame, at: str, text: str, late: str = "1 day") -> DataFrame:
    """Rows whose text was not seen within the watermark; state is a hash per text."""
    return stream.withColumn("__h", F.sha2(F.lower(F.trim(text)), 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def with_known_parents(stream: DataFrame, store: DataFrame, parent: str, key: str) -> DataFrame:
    """A stream-static join to stored scores; parents that come later are for :func:`murmuration.streaming.state.late_parents`."""
    side = store.select(F.col(key).alias(parent), F.col("toxicity").alias("parent_toxicity"))
    return stream.join(side, parent, "left")


def upsert_sink(stream: DataFrame, folder: str, keys: list[str], version: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Each batch is merged into a :class:`KeyedTable`: only the buckets of its keys are rewritten, and a batch that comes again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, folder, keys, version, buckets)
        if table.merge(batch.persist(), number):
            table.clean(keep=2)
        batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter, timeout: int = 300) -> None:
    """Processes what is there and stops."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not end")


def collect_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", timeout: int = 300) -> DataFrame:
    """The result of a bounded stream as an in-memory table, for tests."""
    run_available(stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint), timeout)
    return stream.sparkSession.table(name)


def foreach(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
