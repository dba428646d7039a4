"""Run events: progress by run, as a batch and as a stream, and windowed counts (an addition of ours)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Steps of a run, events that end it, and how long its state is kept after that.
STEPS, TERMINAL, KEEP_MS = 6, ("done", "error"), 60_000


def folded(events: DataFrame) -> DataFrame:
    """run_id, percent, state: the furthest completed step over STEPS, later steps counting as the last (100 once ready), and the last terminal event by seq. Aggregates only, so it runs on streams too."""
    step = F.when(F.col("type") == "stepComplete", F.least("step", F.lit(STEPS)))
    done = F.max(F.when(F.col("type") == "ready", 1).otherwise(0))
    return events.groupBy("run_id").agg(
        F.when(done == 1, 100.0).otherwise(F.coalesce(F.max(step), F.lit(0)) * 100.0 / STEPS).alias("percent"),
        F.coalesce(F.max_by("type", F.when(F.col("type").isin(*TERMINAL), F.col("seq"))), F.lit("running")).alias("state"),
    )


def stream(events: DataFrame, name: str, checkpoint: str):
    """Keeps folded() up to date in a memory table until all that is there has been read."""
    return folded(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events to a Parquet log, until all that is there has been read."""
    return events.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(log: DataFrame, run_id, after: int = -1) -> DataFrame:
    """What a late reader of a run is given: its events so far, in order, from those after the last that it has seen. Nothing follows a terminal one."""
    own = log.where((F.col("run_id") == run_id) & (F.col("seq") > after))
    end = own.where(F.col("type").isin(*TERMINAL)).agg(F.min("seq").alias("_end"))  # one row
    return own.join(F.broadcast(end)).where("_end is null or seq <= _end").drop("_end").orderBy("seq")


def lived(events: DataFrame, keep_ms: int = KEEP_MS) -> DataFrame:
    """run_id, seq, type, change of a stream: a run's first event opens it, its terminal one finishes it (later ones are dropped), and keep_ms later its state is gone."""

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "seq": [None], "type": [None], "change": ["gone"]})
            return
        seen, finished = state.get if state.exists else (False, False)
        for frame in frames:
            rows = frame.sort_values("seq")
            out = []
            for seq, kind in zip(rows["seq"].tolist(), rows["type"].tolist(), strict=True):
                if finished:
                    break
                finished = kind in TERMINAL
                out.append((key[0], seq, kind, "finished" if finished else "opened" if not seen else "event"))
                seen = True
            yield pd.DataFrame(out, columns=["run_id", "seq", "type", "change"])
        state.update((seen, finished))
        if finished:
            state.setTimeoutDuration(keep_ms)

    return events.select("run_id", "seq", "type").groupBy("run_id").applyInPandasWithState(step, "run_id long, seq long, type string, change string", "seen boolean, finished boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and type with a watermark: tumbling, or sliding if slide is given."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")
