"""Streams of tasks and snapshots: windows, sessions, dedup, change detection, stuck tasks.

Each function takes a streaming (or batch) frame with an event time `ts` and returns a
frame; callers attach a sink with a checkpoint, which replaces replaying a log from its
start after every restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """events with `ts` as a timestamp (the session's zone is UTC) and a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """(start, key, n, total) for each tumbling or sliding window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", key: str = "user_id") -> DataFrame:
    """(key, start, end, n): runs of a key's events with gaps shorter than `gap`."""
    return events.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


_OUT = T.StructType([T.StructField("target_url", T.StringType()), T.StructField("id", T.LongType()), T.StructField("previous", T.StringType()), T.StructField("current", T.StringType())])
_STATE = T.StructType([T.StructField("model", T.StringType()), T.StructField("seen", T.BooleanType())])


def pricing_changes(snapshots: DataFrame) -> DataFrame:
    """(target_url, id, previous, current): one row whenever a url's pricing model differs from
    the snapshot before it. The state of a url is its last model; a micro-batch's rows of a
    url are taken in order of (ts, id)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        model, seen = state.get if state.exists else (None, False)
        out = []
        for id_, current in zip(rows["id"], rows["pricing_model"]):
            current = None if pd.isna(current) else current
            if seen and current != model:
                out.append((key[0], id_, model, current))
            model, seen = current, True
        state.update((model, seen))
        yield pd.DataFrame(out, columns=["target_url", "id", "previous", "current"])

    return snapshots.groupBy("target_url").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_ALERT = T.StructType([T.StructField("id", T.LongType()), T.StructField("started", T.TimestampType())])
_RUN = T.StructType([T.StructField("started", T.TimestampType())])


def stuck_alerts(status_events: DataFrame, hours: int = 1) -> DataFrame:
    """(id, started): tasks whose last event says `processing` and that the watermark has left
    behind by `hours`. status_events: (id, status, ts), with a watermark on ts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (started,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "started": [started]})
            return
        last = pd.concat(list(frames)).sort_values("ts").iloc[-1]
        if last["status"] == "processing":
            state.update((last["ts"].to_pydatetime(),))
            state.setTimeoutTimestamp(max(int(last["ts"].timestamp() * 1000) + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": [], "started": []})

    return status_events.groupBy("id").applyInPandasWithState(step, _ALERT, _RUN, "append", GroupStateTimeout.EventTimeTimeout)


def task_source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of task messages, one JSON object a line in files of a folder; lines that are no
    such object give a null taskId and are left out."""
    schema = "taskId string, action string, input struct<topic string, filters struct<business_name string>>, userId string, priority string"
    return spark.readStream.schema(schema).json(path).where("taskId is not null")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything a stream yields of what is there now, written to path and read again."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
