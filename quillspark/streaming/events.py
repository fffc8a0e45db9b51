"""Streams of events: tumbling windows, sessions, first-wins dedup, and leases as state. Each has a batch twin for the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of event files with an event time that takes watermarks."""
    s = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums in fixed windows by type."""
    e = events if late is None else events.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "90 minutes", late: str | None = None) -> DataFrame:
    """Runs of a user's events with no longer gap."""
    e = events if late is None else events.withWatermark("ts", late)
    g = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_wins(events: DataFrame, key: list[str], late: str) -> DataFrame:
    """Q8 on a stream: repeats within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def leases(beats: DataFrame, lease_seconds: int, late: str) -> DataFrame:
    """Q3, Q7 on a stream: for each worker (user_id, beats, ABANDONED) once no beat has come for the lease; state is a count and a
    time, kept until the lease's timer fires."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, _ = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "beats": [n], "status": ["ABANDONED"]})
            return
        n, last = state.get if state.exists else (0, 0)
        for p in parts:
            n += len(p)
            last = max(last, int(p["ts"].max().timestamp() * 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + lease_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    b = beats.withWatermark("ts", late).select("user_id", "ts")
    return b.groupBy("user_id").applyInPandasWithState(step, "user_id long, beats long, status string", "n long, last long", "append", "EventTimeTimeout")


RUN = "user_id long, started timestamp, ended timestamp, beats long"


def lease_runs(beats: DataFrame, lease_seconds: int) -> DataFrame:
    """Q7 over a table: RUN's columns for each run of a worker's beats (user_id, ts) in which the next one came before the lease,
    counted from the last one, was over."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("_at")
    first = F.coalesce(F.col("_at") - F.lag("_at").over(w) >= lease_seconds * 1000, F.lit(True))
    b = beats.where("user_id is not null and ts is not null").select("user_id", ms.alias("_at")).withColumn("_first", first.cast("int"))
    runs = b.withColumn("_run", F.sum("_first").over(w)).groupBy("user_id", "_run").agg(F.min("_at").alias("a"), F.max("_at").alias("z"), F.count(F.lit(1)).alias("beats"))
    return runs.select("user_id", F.timestamp_millis("a").alias("started"), F.timestamp_millis("z").alias("ended"), "beats")


class LeaseTracker(StatefulProcessor):
    """The runs of a worker's beats that are not over yet, and a timer for the end of each one's lease. Beats may come in any order:
    one joins the runs on either side of it. When the watermark has passed the end of a lease, no beat can prolong it any more."""

    def __init__(self, lease_seconds: int) -> None:
        self.lease = lease_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "started long, ended long, beats long")

    def _known(self) -> list[list[int]]:
        return [list(r) for r in self.runs.get()] if self.runs.exists() else []

    def _keep(self, before: list[list[int]], after: list[list[int]]) -> None:
        old, new = {r[1] + self.lease for r in before}, {r[1] + self.lease for r in after}
        for t in old - new:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)
        if after:
            self.runs.put([tuple(r) for r in after])
        else:
            self.runs.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        times = [int(t.timestamp() * 1000) for p in rows for t in p["ts"]]
        after: list[list[int]] = []
        for a, z, n in sorted([list(r) for r in before] + [[t, t, 1] for t in times]):
            if after and a - after[-1][1] < self.lease:
                after[-1][1] = max(after[-1][1], z)
                after[-1][2] += n
            else:
                after.append([a, z, n])
        self._keep(before, after)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        before = self._known()
        over = [r for r in before if r[1] + self.lease <= end]
        left = [r for r in before if r[1] + self.lease > end]
        if left:
            self.runs.put([tuple(r) for r in left])
        else:
            self.runs.clear()
        for a, z, n in over:
            yield pd.DataFrame({"user_id": [key[0]], "started": [pd.Timestamp(a, unit="ms", tz="UTC")], "ended": [pd.Timestamp(z, unit="ms", tz="UTC")], "beats": [n]})

    def close(self) -> None:
        pass


def tracked_leases(beats: DataFrame, lease_seconds: int, late: str) -> DataFrame:
    """X3, Q7 on a stream: lease_runs(), each run once its lease is over. Beats later than the watermark are left out. The session
    needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    b = beats.where("user_id is not null and ts is not null").withWatermark("ts", late).select("user_id", "ts")
    return b.groupBy("user_id").transformWithStateInPandas(LeaseTracker(lease_seconds), RUN, "Append", "EventTime")
