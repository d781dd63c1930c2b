"""Structured Streaming forms of the rollups; run bounded (availableNow) they give the batch results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sporlake.session import checkpoint_folder


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int = 50) -> DataFrame:
    """A file stream over a parquet table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events, users and sum by window and kind; rows later than the watermark are dropped by the engine."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(12,2)")).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """First of repeated events within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def admitted(events: DataFrame, budget: float) -> DataFrame:
    """user_id, admitted, refused, spent: a running budget by user as state; rows of a batch count in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, yes, no = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        for cents in (rows["value"] * 100).round().astype("int64"):
            spent += int(cents)
            yes, no = (yes + 1, no) if spent <= budget * 100 else (yes, no + 1)
        state.update((spent, yes, no))
        yield pd.DataFrame({"user_id": [key[0]], "admitted": [yes], "refused": [no], "spent_cents": [spent]})

    out = "user_id long, admitted long, refused long, spent_cents long"
    return events.groupBy("user_id").applyInPandasWithState(step, out, "spent long, yes long, no long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its result, which is written to the shared folder and read from it.

    In complete mode each batch replaces the one before; in update mode the rows of all batches stay, so that a key
    has as many rows as batches that changed it. Nothing comes to the driver. A batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    out = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
