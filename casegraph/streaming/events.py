"""The event log: appended as JSON lines, served as a stream."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from casegraph import schemas as S
from casegraph.sources.sinks import append_batch, append_stream

EVENT = "event_id string, timestamp string, scan_id string, component string, event_type string, payload map<string,string>"


class EventLog:
    """Appends one JSON object per line; writers in one process take turns."""

    def __init__(self, path: str, scan_id: str):
        self._file, self._scan, self._turn = Path(path), scan_id, threading.Lock()
        self._file.parent.mkdir(parents=True, exist_ok=True)

    def log(self, component: str, event_type: str, payload: dict | None = None) -> str:
        event = {
            "event_id": str(uuid.uuid4()), "timestamp": datetime.now(UTC).isoformat(), "scan_id": self._scan, "component": component,
            "event_type": event_type, "payload": payload or {},
        }
        with self._turn:
            self._append(json.dumps(event, default=str) + "\n", event_type in S.CRITICAL_EVENTS, event["event_id"])
        return event["event_id"]

    def _append(self, line: str, durable: bool, event_id: str) -> None:
        with self._file.open("a", encoding="utf-8") as out:
            out.write(line)
            out.flush()
            if durable:
                os.fsync(out.fileno())


class StoreEventLog(EventLog):
    """The same log in any store that Spark writes to: a folder with a file per event, complete when it is closed."""

    def __init__(self, spark: SparkSession, folder: str, scan_id: str):
        self._folder, self._scan, self._turn = folder.rstrip("/"), scan_id, threading.Lock()
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self._folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _append(self, line: str, durable: bool, event_id: str) -> None:
        out = self._fs.create(self._path(f"{self._folder}/{event_id}.json"))
        out.write(bytearray(line.encode()))
        if durable:
            out.hsync()
        out.close()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log: single ones and batches (folders below it)."""
    return spark.read.schema(EVENT).option("recursiveFileLookup", "true").json(path)


def stream_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(folder)


def log_rows(rows: DataFrame, folder: str, scan_id: str) -> None:
    """An event per row (component, event_type, payload) into a log, written by tasks, a file a task; all of them or none.

    When this returns the events are committed, critical ones among them.
    """
    stamped = rows.select(
        F.expr("uuid()").alias("event_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        F.lit(scan_id).alias("scan_id"), "component", "event_type", F.coalesce("payload", F.create_map().cast("map<string,string>")).alias("payload"),
    )
    append_batch(stamped, folder)


def critical(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*S.CRITICAL_EVENTS))


def durable_sink(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An exactly-once JSON sink: a batch's events appear together, and what is committed survives a restart from the checkpoint."""
    return append_stream(events, path, checkpoint)


def as_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a TIMESTAMP; the tables hold TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def distinct_events(events: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event per key; state is kept for the watermark's delay only."""
    return as_event_time(events, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type (an extension: the data model has no event-time windows)."""
    timed = as_event_time(events, time).withWatermark(time, delay)
    out = timed.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    timed = as_event_time(events, time).withWatermark(time, delay)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


# The states of a path, in order; a later state of one path replaces an earlier one.
TRANSITIONS = {"QUEUED": 0, "RUNNING": 1, "UNRESOLVED": 2, "RESOLVED": 3}
#: How long, in event time, a resolved path is remembered (so that replays of its earlier transitions change nothing), and one that nobody moves on.
LINGER_MS, ABANDONED_MS = 3_600_000, 7 * 24 * 3_600_000


def path_states(
    transitions: DataFrame, time: str | None = None, delay: str = "10 minutes", linger_ms: int = LINGER_MS, abandoned_ms: int = ABANDONED_MS
) -> DataFrame:
    """A stream of (path_id, state, seq) -> the state of each path after each batch (update mode).

    A transition older than the state on record is ignored, so replays change nothing while a path is remembered. With
    ``time``, the transitions' event time, every path has a timer, set anew when it moves: once the watermark has passed it, a
    resolved path leaves the state ``linger_ms`` after it was resolved, any other one ``abandoned_ms`` after its
    last transition, and the state holds live paths, not all there ever were; transitions that are late by more than ``delay``
    are dropped. Event time, as timers by the clock would keep a stream that takes what is there from ending. Without ``time`` nothing leaves.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before, current = state.get if state.exists else (-1, None)
        seq, at = before, 0
        for batch in batches:
            later = batch[batch["state"].isin(TRANSITIONS) & (batch["seq"] > seq)]
            if len(later):
                last = later.loc[later["seq"].idxmax()]
                seq, current = int(last["seq"]), last["state"]
            if time is not None and len(batch):
                at = max(at, int(batch[time].max().timestamp() * 1000))
        if current is None:
            return
        if seq != before:
            state.update((seq, current))
        if time is not None:
            # A timer does not outlive the call that sees new rows, so it is set by each.
            deadline = at + (linger_ms if current == "RESOLVED" else abandoned_ms)
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path_id": [key[0]], "state": [current], "seq": [seq]})

    timed = transitions if time is None else as_event_time(transitions, time).withWatermark(time, delay)
    return timed.groupBy("path_id").applyInPandasWithState(
        advance, "path_id string, state string, seq long", "seq long, state string", "update", "NoTimeout" if time is None else "EventTimeTimeout"
    )
