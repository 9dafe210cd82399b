"""Streams with a state of their own for each key: upload jobs, and recordings between a start and a stop.

Both take events late and out of order, as far as the stream's watermark allows, give what the batch folds give, and let
go of a key's state once the watermark says that nothing more can change it. Both need a state store that keeps
several values a key: ``use_state_store`` names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspan.sources.files import EVENT_PADDING_SEC
from reelspan.streaming.jobs import FINISHED

#: How late an event may be; how long a start waits for its stop.
LATENESS, LONGEST_RECORDING_SEC = "10 minutes", 24 * 3600
JOB = "job_id long, state string, progress long, message string, last_seq long"
_JOB_STATE = "state string, progress long, last_seq long, message string, message_seq long"
WINDOW = "session_id long, event_no long, start_at timestamp, end_at timestamp"


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that these streams need, in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(value) -> int:
    return int(pd.Timestamp(value).timestamp() * 1000)


class JobTracker(StatefulProcessor):
    """The last state, progress and message of a job, by its events' numbers. A finished job goes once the watermark has
    passed its last event, when no earlier one can come any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job, self.timer = handle, handle.getValueState("job", _JOB_STATE), handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, progress, last, message, message_at = self.job.get() if self.job.exists() else (None, None, None, None, None)
        latest = self.timer.get()[0] if self.timer.exists() else None
        before = latest
        for batch in rows:
            for seq, s, p, m, at in zip(batch["seq"], batch["state"], batch["progress"], batch["message"], batch["at"], strict=True):
                seq, p = int(seq), None if pd.isna(p) else int(p)
                if last is None or seq > last:
                    state, progress, last = None if pd.isna(s) else s, p, seq
                if isinstance(m, str) and m.strip() and (message_at is None or seq > message_at):
                    message, message_at = m, seq
                latest = max(latest or 0, _millis(at))
        self.job.update((state, progress, last, message, message_at))
        self.timer.update((latest,))
        if before is not None and before != latest:
            self.handle.deleteTimer(before)
        if before != latest:
            self.handle.registerTimer(latest)
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "progress": [progress], "message": [message], "last_seq": [last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists() and self.job.get()[0] in FINISHED:
            self.job.clear()
            self.timer.clear()
        return iter(())


def job_updates(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """A row for each job that a batch of a stream (seq, job_id, state, progress, message, at) has events of, as
    ``jobs.job_states`` gives it for all events so far. Repeated events change nothing; events later than
    ``lateness`` are dropped. Output mode: update."""
    timed = events.withWatermark("at", lateness).select("job_id", "seq", "state", "progress", "message", "at")
    return timed.groupBy("job_id").transformWithStateInPandas(JobTracker(), JOB, "update", "eventTime")


class RecordingPairs(StatefulProcessor):
    """Events of a session wait until the watermark has passed them, and are then read in order of their numbers: a start
    opens, a stop that follows it closes, and anything else lets the open start go."""

    def __init__(self, longest_sec: float):
        self.longest_sec = longest_sec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_no long", "kind string, at timestamp")
        self.open = handle.getValueState("open", "event_no long, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for number, kind, at in zip(batch["event_no"], batch["kind"], batch["at"], strict=True):
                self.waiting.updateValue((int(number),), (kind, pd.Timestamp(at).to_pydatetime()))
                self.handle.registerTimer(_millis(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        ready = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator() if _millis(v[1]) <= passed)
        start = tuple(self.open.get()) if self.open.exists() else None
        for number, kind, at in ready:
            self.waiting.removeKey((number,))
            if kind == "stop" and start is not None:
                out.append((key[0], start[0], start[1] - pd.Timedelta(seconds=EVENT_PADDING_SEC), at + pd.Timedelta(seconds=EVENT_PADDING_SEC)))
            start = (number, at) if kind == "start" else None
        if start is not None and passed - _millis(start[1]) > 1000 * self.longest_sec:
            start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update(start)
            if ready:  # looked at again when it has waited too long
                self.handle.registerTimer(_millis(start[1]) + int(1000 * self.longest_sec) + 1)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "event_no", "start_at", "end_at"])


def recording_windows(events: DataFrame, lateness: str = LATENESS, longest_sec: float = LONGEST_RECORDING_SEC) -> DataFrame:
    """Windows of a stream of recorder events (session_id, event_no, kind, at), as ``files.recording_windows`` gives them, each
    once the watermark has passed its stop. A start that waits longer than ``longest_sec`` for the next event goes. Output mode:
    append."""
    timed = events.where(F.col("event_no").isNotNull() & F.col("at").isNotNull()).withWatermark("at", lateness).select("session_id", "event_no", "kind", "at")
    return timed.groupBy("session_id").transformWithStateInPandas(RecordingPairs(longest_sec), WINDOW, "append", "eventTime")
