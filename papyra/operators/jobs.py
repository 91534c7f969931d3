"""Queues and jobs: summaries, claim order, lanes, de-duplication, rate limits and the fold of job events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.values import transient

#: Priorities of job kinds (fixed values).
PRIORITIES = {"parse_article": 100, "import_arxiv": 90, "translate_block": 50, "generate_reader_card": 40, "export_article": 30, "embed_article": 20, "extract_reader_cards": 10}


def summary(jobs: DataFrame, status: str, updated: str) -> DataFrame:
    """status, jobs, latest: the number of jobs in each status and its latest change."""
    return jobs.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("jobs"), F.max(updated).alias("latest"))


def default_priority(kind: Column) -> Column:
    """The priority of a kind of job, 0 for others."""
    out = F.when(F.lit(False), 0)
    for name, value in PRIORITIES.items():
        out = out.when(kind == name, value)
    return out.otherwise(0)


def claim_order(jobs: DataFrame, order: list[Column], k: int, *select: str) -> DataFrame:
    """The k jobs that are claimed next, with their place."""
    best = jobs.orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", *select)


def lane_heads(jobs: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    """The job of each lane that is claimed next: a maximum, so each task sends one row a lane."""
    return jobs.withColumn("papyra_n", F.row_number().over(Window.partitionBy(lane).orderBy(*order))).where("papyra_n = 1").drop("papyra_n")


def status_counts(jobs: DataFrame, owner: str, status: str, states: list[str]) -> DataFrame:
    """owner and the number of its jobs in each state."""
    return jobs.groupBy(owner).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states])


def first_of_each(jobs: DataFrame, keys: list[str], order: str, id_col: str) -> DataFrame:
    """keys, id, copies: the first job of each key and how many there are."""
    return jobs.groupBy(*keys).agg(F.min_by(id_col, F.struct(order, id_col)).alias(id_col), F.count(F.lit(1)).alias("copies"))


def slots(requests: DataFrame, lane: str, at_ms: str, id_col: str, interval_ms: int, range_ms: int = 3_600_000) -> DataFrame:
    """The start of each request when a lane takes one per interval: next = max(next, now) + interval, in closed form.

    A lane is sorted in ranges of time, each a task's group, and its ranges pass on two numbers each: how many requests
    they hold and the furthest that one lies ahead of its place. Requests without a time come first, take places and have
    no start.
    """
    spot, bucket = F.col("papyra_spot"), F.floor(F.col(at_ms) / range_ms)
    rows = requests.withColumn("papyra_range", bucket)
    w = Window.partitionBy(lane, "papyra_range").orderBy(at_ms, id_col)
    rows = rows.withColumn("papyra_spot", (F.row_number().over(w) - 1).cast("long") * interval_ms)
    rows = rows.withColumn("papyra_ahead", F.max(F.col(at_ms) - spot).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    furthest = rows.groupBy(F.col(lane).alias("papyra_lane"), F.col("papyra_range").alias("papyra_key")).agg(F.count(F.lit(1)).alias("papyra_n"), F.max("papyra_ahead").alias("papyra_most"))
    before = Window.partitionBy("papyra_lane").orderBy("papyra_key").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("papyra_n").over(before), F.lit(0)) * interval_ms
    carried = furthest.withColumn("papyra_shift", shift)
    carried = carried.withColumn("papyra_carry", F.max(F.col("papyra_most") - F.col("papyra_shift")).over(before))

    same = F.col(lane).eqNullSafe(F.col("papyra_lane")) & F.col("papyra_range").eqNullSafe(F.col("papyra_key"))
    joined = rows.join(carried, same)
    start = spot + F.col("papyra_shift") + F.greatest("papyra_carry", F.col("papyra_ahead") - F.col("papyra_shift"))
    return joined.select(*requests.columns, start.alias("start_ms"))


#: State after an event, by event and the states it applies to; an empty set stands for any.
TRANSITIONS = {
    "claim": ({"queued"}, "running"),
    "pause": (set(), "paused"),
    "resume": ({"paused"}, None),
    "cancel": ({"queued", "running", "paused", "cancelled"}, "cancelled"),
    "complete": ({"running"}, "succeeded"),
    "fail": ({"running"}, "failed"),
    "requeue": ({"running", "failed"}, "queued"),
}


def step(state: str, started: bool, attempts: int, event: str) -> tuple[str, bool, int]:
    """(state, whether it ever started, attempts) after an event; events that don't apply change nothing."""
    allowed, to = TRANSITIONS.get(event, ({None}, None))
    if allowed and state not in allowed:
        return state, started, attempts
    if event == "resume":
        to = "running" if started else "queued"
    return to, started or event == "claim", attempts + (event == "claim")


def fold(events: DataFrame, job: str, at: str, event: str) -> DataFrame:
    """job, state, attempts after all of a job's events in order of `at`. A job's events are one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state = ("queued", False, 0)
        for name in group.sort_values(at, kind="stable")[event]:
            state = step(*state, name)
        return pd.DataFrame({job: [group[job].iloc[0]], "state": [state[0]], "attempts": [state[2]]})

    return events.select(job, at, event).groupBy(job).applyInPandas(run, f"{job} {events.schema[job].dataType.simpleString()}, state string, attempts long")


def retried(jobs: DataFrame, attempts: str, error: str, most: int = 3) -> DataFrame:
    """Failed jobs with what becomes of them: another try for passing errors while attempts are left."""
    return jobs.withColumn("next_state", F.when(transient(F.col(error)) & (F.col(attempts) < most), "queued").otherwise("failed"))
