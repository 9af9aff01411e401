"""Streams over job events (job, ts, kind): activity in windows, sessions by gap, a heartbeat state machine and the retention of artefacts.

These are extensions: they restate job control that is otherwise done by polling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_SECONDS = 90
TERMINAL = ("done", "error", "cancelled")


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; later ones than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def sessions(events: DataFrame, gap: str = f"{GAP_SECONDS} seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of polling of a job without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "job").agg(F.count(F.lit(1)).alias("polls")).select("job", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "polls")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers and expiry is kept in RocksDB, beside the checkpoint, so that it may grow beyond an executor's memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class JobLife(StatefulProcessor):
    """A job's status and polls by key. Each poll moves the job's timer on; when event time passes it, nobody watches any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "polls long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls, due = self.life.get() if self.life.exists() else (0, 0)
        newest, ends = 0, []
        for b in rows:
            polls += len(b)
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
            ends += [(t, k) for t, k in zip(b["ts"], b["kind"]) if k in TERMINAL]
        if due:
            self.handle.deleteTimer(due)
        if ends:
            self.life.clear()
            yield pd.DataFrame({"job": [key[0]], "status": [min(ends)[1]], "polls": [polls]})
            return
        due = max(due, newest + GAP_SECONDS * 1000, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.life.update((polls, due))
        yield pd.DataFrame({"job": pd.Series([], dtype="int64"), "status": pd.Series([], dtype="str"), "polls": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        polls, _ = self.life.get()
        self.life.clear()
        yield pd.DataFrame({"job": [key[0]], "status": ["cancelled"], "polls": [polls]})

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(job, status, polls) once a job ends: by its own event, or cancelled when nobody polls for GAP_SECONDS of event time. Events older than the watermark are dropped."""
    use_state_store(events.sparkSession)
    return events.withWatermark("ts", late).groupBy("job").transformWithStateInPandas(JobLife(), "job long, status string, polls long", "append", "EventTime")


class Retained(StatefulProcessor):
    """The artefacts of a plan that are still kept: an entry of a map per artefact, forgotten `keep_ms` after its last use. What is forgotten is not counted in the plan's bytes."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "name string", "bytes long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for name, size in zip(b["name"], b["bytes"]):
                self.kept.updateValue((name,), (int(size),))
        sizes = [v[0] for v in self.kept.values()]
        yield pd.DataFrame({"plan": [key[0]], "artefacts": [len(sizes)], "bytes": [sum(sizes)]})

    def close(self) -> None:
        pass


def retained(uses: DataFrame, keep_ms: int) -> DataFrame:
    """(plan, artefacts, bytes) after each batch of uses (plan, name, bytes) that touches the plan: artefacts unused for keep_ms of processing time are gone by themselves (state with a time to live)."""
    use_state_store(uses.sparkSession)
    return uses.groupBy("plan").transformWithStateInPandas(Retained(keep_ms), "plan long, artefacts long, bytes long", "update", "ProcessingTime")
