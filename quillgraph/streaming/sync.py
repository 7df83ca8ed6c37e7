"""Keeping a stored graph in step with its source: signatures, differences, and the same by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def signed(rows: DataFrame, key: str) -> DataFrame:
    """key and sig, a digest of the whole row."""
    return rows.select(key, F.sha1(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).alias("sig"))


def differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change (delete, insert or update) between two states of a table: one full outer join of keys and digests."""
    a = signed(before, key).withColumnRenamed("sig", "old")
    b = signed(after, key).withColumnRenamed("sig", "new")
    change = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "insert").when(F.col("old") != F.col("new"), "update")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def apply(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The state after the differences: unchanged rows of before, changed and new ones of after."""
    changed = differences(before, after, key)
    stays = before.join(changed.filter("change <> 'insert'"), key, "left_anti")
    comes = after.join(changed.filter("change <> 'delete'"), key, "left_semi")
    return stays.unionByName(comes)


def follow(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs handle on each micro-batch of a streaming DataFrame; a checkpoint in shared storage lets it go on where it was."""
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by window and type; on a stream, state older than the watermark is dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def file_stream(spark: SparkSession, folder: str, files: str, schema: T.StructType, at_once: int | None = None) -> DataFrame:
    """The rows of the parquet files of a folder that fit a name pattern, as they arrive; at_once: files in a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", at_once) if at_once else reader).parquet(folder)


def land(events: DataFrame, folder: str, key: str, time: str = "ts", late: str = "1 day") -> None:
    """Adds what has arrived to the table in a folder, each key once, however often it is delivered within ``late``, and returns when that is done.

    The sink and its checkpoint are in the folder, so a run that broke off is taken up where it was and no row is written twice. State older than
    the watermark is dropped, and rows older than it too: ``late`` is how far rows may be out of order.
    """
    once = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    query = once.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
