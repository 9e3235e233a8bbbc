"""Structured Streaming jobs: windowed metrics, de-duplication, triage. State is bounded by watermarks."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ticketloom.session import scratch_path
from ticketloom.sources import sinks

WATERMARK = "1 day"


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def timed(stream: DataFrame, column: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """Zoned event time (UTC session) with a watermark; watermarks do not accept zoneless timestamps."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, watermark)


def daily_endpoint_metrics(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Requests and mean latency per day and endpoint; rows later than the watermark allows are dropped."""
    windows = timed(logs, "created_at", watermark).groupBy(F.window("created_at", "1 day"), "endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("latency_ms").alias("mean_latency_ms")
    )
    return windows.select(F.col("window.start").alias("day"), "endpoint", "requests", "mean_latency_ms")


def sliding_weekly_volume(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Requests in each seven-day window, one window per day."""
    windows = timed(logs, "created_at", watermark).groupBy(F.window("created_at", "7 days", "1 day")).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return windows.select(F.col("window.start").alias("start"), "requests")


def deduplicated(stream: DataFrame, key: str, event_time: str = "created_at", watermark: str = WATERMARK) -> DataFrame:
    """The first row per key within the watermark; rows without a key all pass, equal ones too."""
    stream = timed(stream, event_time, watermark)
    keyed = stream.where(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return keyed.unionByName(stream.where(F.col(key).isNull()))


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Works through what has arrived, writes it to the shared folder and returns it as a table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    stream.writeStream.outputMode(mode).option("checkpointLocation", path + "/_progress").trigger(
        availableNow=True
    ).format("parquet").option("path", path + "/data").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/data")


@dataclass(frozen=True)
class ChangeLog:
    """A table kept as the rows that each micro-batch has written or changed, below ``root``.

    Batch n writes the folder of batch n alone, so its cost follows the batch and a repeated batch leaves one copy.
    ``progress`` is the stream's checkpoint; a run with the same two folders goes on where the last one ended.
    """

    spark: SparkSession
    root: str
    progress: str

    def run(self, stream: DataFrame, mode: str = "append", handle: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Works through what has arrived; ``handle`` turns a batch into the rows to write."""

        def write(batch: DataFrame, number: int) -> None:
            sinks.publish(handle(batch) if handle else batch, f"{self.root}/batch={number}", mode="overwrite")

        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", self.progress).trigger(
            availableNow=True
        ).start().awaitTermination()

    def table(self, schema: StructType, keys: list[str], first: tuple[str, ...] = ()) -> DataFrame:
        """The newest row per key; the columns ``first`` keep the value of the oldest. Rows with a NULL key are all kept.

        Before the first batch the table is empty.
        """
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/batch=-1")
        changes = self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(self.root)
        rest = [c for c in schema.names if c not in keys]
        whole = functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        picks = [(F.min_by if c in first else F.max_by)(F.struct(c), F.col("batch")).alias(c) for c in rest]
        newest = changes.where(whole).groupBy(*keys).agg(*picks)
        newest = newest.select(*keys, *[F.col(f"{c}.{c}").alias(c) for c in rest]).select(*schema.names)
        return newest.unionByName(changes.where(~whole).select(*schema.names))

    def compact(self, schema: StructType, keys: list[str], to: str, first: tuple[str, ...] = ()) -> None:
        """Writes the newest rows as the only batch of a new root, from which a later run can go on."""
        sinks.publish(self.table(schema, keys, first), f"{to}/batch=-1")


def run_to_latest(stream: DataFrame, keys: list[str], label: str, root: str | None = None, progress: str | None = None) -> DataFrame:
    """Works through what has arrived in update mode and returns the newest row per key, open windows included."""
    path = scratch_path(stream.sparkSession, label)
    log = ChangeLog(stream.sparkSession, root or path + "/data", progress or path + "/progress")
    log.run(stream, mode="update")
    return log.table(stream.schema, keys)


PREDICTIONS = "predicted_category string, predicted_priority string, predicted_confidence double, assignee_queue string"


def triage_stream(
    tickets: DataFrame, triage: Callable[[DataFrame], DataFrame], label: str = "triage",
    root: str | None = None, progress: str | None = None,
) -> DataFrame:
    """Scores each micro-batch with ``triage`` and upserts it by ticket id; returns the table as it stands.

    ``triage`` gives (ticket_id, predicted_category, predicted_priority, predicted_confidence, assignee_queue). Of rows
    with the same ticket in a batch the last by content counts; a known ticket keeps its status. ``root`` and ``progress``
    let a later run go on.
    """
    spark = tickets.sparkSession
    path = scratch_path(spark, label)
    log = ChangeLog(spark, root or path + "/data", progress or path + "/progress")
    kind = tickets.schema["ticket_id"].dataType.simpleString()
    schema = spark.createDataFrame([], f"ticket_id {kind}, status string, {PREDICTIONS}").schema

    def scored(batch: DataFrame) -> DataFrame:
        rows = triage(batch).withColumn("status", F.lit("open")).select(*schema.names)
        return sinks.last_per_key(rows, "ticket_id", F.struct(*schema.names[1:]))

    log.run(tickets, handle=scored)
    return log.table(schema, ["ticket_id"], first=("status",))
