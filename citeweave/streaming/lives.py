"""The end of a run's life in two steps: its subscribers are let go shortly after its terminal event, and it is forgotten a while later.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as keyed state with timers does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .progress import KEEP_MS, TERMINAL

#: Fixed value: how long after the terminal event subscribers may still read it.
CLOSE_MS = 250
CHANGES = "run_id long, seq long, type string, change string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Life(StatefulProcessor):
    """opened, event and finished for rows; closed and gone as timers run out. State that is never finished is given up after ``idle_ms`` without an event."""

    def __init__(self, close_ms: int, keep_ms: int, idle_ms: int):
        self.close_ms, self.keep_ms, self.idle_ms = close_ms, keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phase = handle.getValueState("phase", "phase string", ttlDurationMs=self.idle_ms)

    def _phase(self) -> str | None:
        return self.phase.get()[0] if self.phase.exists() else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        phase = self._phase()
        for row in sorted(rows, key=lambda r: r["seq"]):  # a run's events of one batch
            if phase in ("finished", "closed"):
                break  # nothing follows a terminal event
            change = "finished" if row["type"] in TERMINAL else "event" if phase else "opened"
            phase = "finished" if change == "finished" else "open"
            yield Row(run_id=key[0], seq=row["seq"], type=row["type"], change=change)
            if phase == "finished":
                now = timerValues.getCurrentProcessingTimeInMs()
                self.handle.registerTimer(now + self.close_ms)
        self.phase.update((phase,))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self._phase() == "finished":
            self.phase.update(("closed",))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
            yield Row(run_id=key[0], seq=None, type=None, change="closed")
        else:
            self.phase.clear()
            yield Row(run_id=key[0], seq=None, type=None, change="gone")


def lives(events: DataFrame, close_ms: int = CLOSE_MS, keep_ms: int = KEEP_MS, idle_ms: int = 86_400_000) -> DataFrame:
    """run_id, seq, type, change of a stream of events (run_id, seq, type): each event, then ``closed`` close_ms after the terminal one, and ``gone`` keep_ms after that. Later events of a finished run are dropped until it is gone."""
    rows = events.select("run_id", "seq", "type")
    return rows.groupBy("run_id").transformWithState(_Life(close_ms, keep_ms, idle_ms), CHANGES, "append", "processingTime")
