"""Counts of rows as they pass a stage, without a pass of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Stages:
    """Watches stages of a batch run: the job that computes a stage counts its rows on the way. A stage's counts are there once an action has run over it; a stage that is read twice in one action counts once for each reading, so watch what is written or staged."""

    def __init__(self) -> None:
        self._watched: dict[str, Observation] = {}

    def watched(self, df: DataFrame, stage: str, **more: Column) -> DataFrame:
        """df, its rows counted under the stage's name, with more aggregates if some are named."""
        if stage in self._watched:
            raise ValueError(f"a stage named {stage} is watched already")
        self._watched[stage] = Observation(stage)
        return df.observe(self._watched[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])

    def counts(self) -> dict[str, dict]:
        """What has been counted, by stage in the order watched; waits for stages whose action is running, and must not be asked before one has begun."""
        return {stage: dict(o.get) for stage, o in self._watched.items()}


class StreamProgress(StreamingQueryListener):
    """Calls back after each batch of a stream with its name, batch id, input rows and the counts of stages observed in it (see observed())."""

    def __init__(self, call: Callable[[str | None, int, int, dict], None]) -> None:
        self.call = call

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.call(p.name, p.batchId, p.numInputRows, {stage: row.asDict() for stage, row in (p.observedMetrics or {}).items()})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def observed(stream: DataFrame, stage: str) -> DataFrame:
    """A stream whose batches report their rows under the stage's name."""
    return stream.observe(stage, F.count(F.lit(1)).alias("rows"))
