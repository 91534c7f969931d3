"""Reading time, job states and change feeds over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.operators.jobs import step


def reading_time_stream(events: DataFrame, keys: list[str], seconds: str, at: str, longest: float = 3600) -> DataFrame:
    """keys, seconds, last: running reading time of each key (update mode)."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(float(longest)), F.col(seconds)))
    return events.groupBy(*keys).agg(F.sum(part).alias("seconds"), F.max(at).alias("last"))


def windowed_counts(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """start, key, n per window of event time; rows later than `late` are dropped (append mode)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def job_states(events: DataFrame, job: str, at: str, event: str) -> DataFrame:
    """job, state, attempts after each batch's events (update mode); the state of a job is one row."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else ("queued", False, 0)
        rows = pd.concat(list(batches))
        for name in rows.sort_values(at, kind="stable")[event]:
            now = step(now[0], now[1], now[2], name)
        state.update(now)
        yield pd.DataFrame({job: [key[0]], "state": [now[0]], "attempts": [now[2]]})

    kind = events.schema[job].dataType.simpleString()
    return events.select(job, at, event).groupBy(job).applyInPandasWithState(run, f"{job} {kind}, state string, attempts long", "state string, started boolean, attempts long", "update", GroupStateTimeout.NoTimeout)


def on_change(counts: DataFrame, send: Callable[[list], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that sends a small summary (a row for each status) whenever it differs from the last one sent."""
    last: list = []

    def batch(rows: DataFrame, _: int) -> None:
        now = sorted(map(tuple, rows.collect()), key=str)
        if now != last:
            last[:] = now
            send(now)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(batch).start()
