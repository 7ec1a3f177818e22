"""Structured Streaming over event files: event-time tumbling counts, and count-based windows with a state for each capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.sources.sinks import scratch


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """events.parquet as a stream, ts as a timestamp in UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts by event type and window of event time; what comes later than `late` behind the newest event is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def count_windows(frames: DataFrame, size: int) -> DataFrame:
    """Windows of `size` messages of each capture, emitted as they fill: capture, widx, first_us, last_us.

    The state of a capture is its number of whole windows and the messages of the open one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, open_us = state.get if state.exists else (0, [])
        rows = pd.concat(list(parts)).sort_values("seq")
        times = [*open_us, *rows["us"].tolist()]
        out = []
        while len(times) >= size:
            out.append((key[0], done, times[0], times[size - 1]))
            done, times = done + 1, times[size:]
        state.update((done, times))
        yield pd.DataFrame(out, columns=["capture", "widx", "first_us", "last_us"])

    shape = "capture string, widx long, first_us long, last_us long"
    return frames.groupBy("capture").applyInPandasWithState(step, shape, "done long, open array<long>", "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs the stream over all that is there, into Parquet ('append') or memory ('complete'), and returns the result."""
    folder = scratch(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    table = name + folder[-32:]
    writer.format("memory").queryName(table).start().awaitTermination()
    return spark.table(table)


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type, counted by the stream."""
    counted = drained(spark, tumbling(read_events(spark, sf_dir), "1 day", "1 hour"), "complete", "daily")
    return counted.select("event_type", F.floor(F.unix_micros("window.start") / 86_400_000_000).alias("day"), "n")
