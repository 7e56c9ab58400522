"""Streaming forms of the quality-control and station queries (Structured Streaming, event time, watermarks)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, directory: str, files_per_trigger: int = 1) -> DataFrame:
    """The stream of a directory of Parquet files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def quality_controlled(stream: DataFrame, bad: list[str], late: str = "2 days") -> DataFrame:
    """Rows of good status with a value, each event once; later ones than the watermark are dropped."""
    ok = ~F.coalesce(F.col("event_type").isin(bad), F.lit(False)) & F.col("value").isNotNull()
    return stream.filter(ok).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily_means(stream: DataFrame, late: str = "2 days", slide: str | None = None, width: str = "1 day") -> DataFrame:
    """user_id, start, n, mean_value per window; sliding if slide is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        stream.withWatermark("ts", late)
        .groupBy("user_id", w)
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
        .select("user_id", F.col("window.start").alias("start"), "n", "mean_value")
    )


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Runs of readings without a gap."""
    return (
        stream.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )


def bucket_state(stream: DataFrame, wp: float = 100.0, fc: float = 250.0, sat: float = 450.0, drain: float = 0.6, pet: float = 20.0) -> DataFrame:
    """user_id, n, storage: the water bucket of each station, carried between micro-batches; a batch's rows run in time order."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, fc)
        for value in pd.concat(list(frames)).sort_values(["ts", "event_id"])["value"]:
            s += value
            s -= min(pet, max(s - wp, 0.0))
            s -= drain * max(s - fc, 0.0)
            s, n = min(max(s, wp), sat), n + 1
        state.update((n, s))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "storage": [s]})

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n long, storage double", "n long, storage double", "update", GroupStateTimeout.NoTimeout
    )


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Run all that is there into an in-memory table."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
