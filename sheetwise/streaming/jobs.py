"""Job events as a stream: the latest state of each job, what is pending, and arriving page pairs in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import ACTIVE, TERMINAL

EVENTS = "job_id long, status string, at timestamp"
LIFE = ["queued", "running", "completed", "failed"]


def job_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Events (EVENTS) from Parquet files as they arrive; a batch takes no more files than the limit of pending jobs."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_states(events: DataFrame) -> DataFrame:
    """(job_id, status, updated_at): the last state of each job; of states at one time the later one in a job's life."""
    life = F.array(*(F.lit(s) for s in LIFE))
    last = F.max(F.struct("at", F.array_position(life, F.col("status")).alias("step"), "status"))
    return events.groupBy("job_id").agg(last.alias("last")).select("job_id", "last.status", F.col("last.at").alias("updated_at"))


def stored(events: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(job_id, status, updated_at, gone): a row for each change of a job, and a last one (gone) when it has been ended for the time that it is kept. The state of a job is its last status; ended jobs leave the store by event time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, at, gone: pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_at": [pd.Timestamp(at, unit="us")], "gone": [gone]})
        if state.hasTimedOut:
            status, at = state.get
            state.remove()
            yield row(status, at, True)
            return
        before = state.getOption
        last = (before[1], LIFE.index(before[0])) if before else None
        for batch in batches:
            for at, status in zip(batch["at"].astype("datetime64[us]").astype("int64"), batch["status"], strict=True):
                if status in LIFE:
                    last = max(last, (int(at), LIFE.index(status))) if last else (int(at), LIFE.index(status))
        if last is None:
            return
        status, at = LIFE[last[1]], last[0]
        state.update((status, at))
        if status in TERMINAL:
            state.setTimeoutTimestamp(max(at // 1000 + 1000 * ttl_seconds, state.getCurrentWatermarkMs() + 1))
        if before != (status, at):
            yield row(status, at, False)

    keyed = events.withWatermark("at", late).groupBy("job_id")
    return keyed.applyInPandasWithState(run, "job_id long, status string, updated_at timestamp, gone boolean", "status string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def activity(events: DataFrame, late: str = "1 hour", span: str = "10 minutes") -> DataFrame:
    """(window, status, n): events by tumbling window of event time; windows close when the watermark has passed them."""
    counts = events.withWatermark("at", late).groupBy(F.window("at", span).alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "status", "n")


def pending(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("pending"))


def run_pairs(arrivals: DataFrame, compare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Compare arriving pairs batch by batch and append the records under out, by batch number, so that a repeated batch replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        compare(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
