"""Structured Streaming over event logs: notices once, last activity, windows with late data, rate limits, leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources.shared import shared_path


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the file or folder at a path, with event time in UTC. The path is given as a pattern, since a stream takes a single file only so."""
    kinds = spark.read.parquet(path).schema
    return spark.readStream.schema(kinds).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of the shared folder; progress is kept in its checkpoint, so a run that was cut off goes on where it stopped."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", shared_path(spark, f"{name}-progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def notices(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """One row a user, type and day; state is dropped behind the watermark."""
    keyed = events.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts").withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def window_counts(events: DataFrame, length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Events by type and window, once the watermark has passed the window's end."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("starts"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """A user's sessions, once closed."""
    s = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "n")


def limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, event_id, allowed: at most so many allowed events of a user in a window that starts at its first hit. A user's state is two numbers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        began, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for at, event in zip((rows["ts"].astype("int64") // 1000).tolist(), rows["event_id"].tolist(), strict=True):
            if began is None or at - began >= seconds * 1_000_000:
                began, n = at, 0
            n += 1
            out.append((key[0], event, n <= most))
        state.update((began, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    timed = events.select("user_id", "event_id", F.col("ts"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, allowed boolean", "began long, n int", "append", "NoTimeout")
