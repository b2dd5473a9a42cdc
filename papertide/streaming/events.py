"""Streaming forms of the job fold and of intake; each gives what its batch form gives once all input is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import STOPPED
from ..sources.tables import KeyedTable


def deduplicated(messages: DataFrame, key: str = "message_id", at: str = "imported_at", late: str = "3 days") -> DataFrame:
    """Overlapping reads of a mailbox: each message once within the time that reads overlap."""
    return messages.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def events_per_window(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of a column's values in windows of time. Not an operator of the queue; a view of its load."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def folded(events: DataFrame, late: str | None = "3 days") -> DataFrame:
    """events(job_id, event_id, to_state, created_at): each job's state after each batch; late events don't move it back, and events that
    come again within `late` don't count again."""
    if late:
        timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
        events = timed.dropDuplicatesWithinWatermark(["event_id"])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, event, last, n = state.get if state.exists else (0, -1, None, 0)
        for rows in batches:
            n += len(rows)
            top = rows.sort_values(["at", "event_id"]).iloc[-1]
            if (int(top["at"]), int(top["event_id"])) > (at, event):
                at, event, last = int(top["at"]), int(top["event_id"]), str(top["to_state"])
        state.update((at, event, last, n))
        yield pd.DataFrame({"job_id": [key[0]], "state": [last], "n_events": [n], "stopped": [last in STOPPED]})

    source = events.select("job_id", "event_id", "to_state", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    return source.groupBy("job_id").applyInPandasWithState(step, "job_id long, state string, n_events long, stopped boolean", "at long, event long, last string, n long", "update", GroupStateTimeout.NoTimeout)


def expired_leases(events: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """events(job_id, event_id, to_state, created_at): jobs that a worker took and from which nothing was heard for so long, by a timer on event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, _, last = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": [last], "leased_at": [at]})
            return
        at, event, last = state.get if state.exists else (0, -1, "queued")
        for rows in batches:
            top = rows.sort_values(["at", "event_id"]).iloc[-1]
            if (int(top["at"]), int(top["event_id"])) > (at, event):
                at, event, last = int(top["at"]), int(top["event_id"]), str(top["to_state"])
        state.update((at, event, last))
        if last not in (*STOPPED, "queued", "retry"):
            state.setTimeoutTimestamp(max(at // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    source = timed.select("job_id", "event_id", "to_state", "created_at", F.unix_micros("created_at").alias("at"))
    return source.groupBy("job_id").applyInPandasWithState(step, "job_id long, state string, leased_at long", "at long, event long, last string", "append", GroupStateTimeout.EventTimeTimeout)


def merging(stream: DataFrame, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str):
    """Each batch merged into the newest version of a table: version n is what batch n left, so a repeated batch changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/v={n - 1}") if n else None
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merging_into(stream: DataFrame, table: KeyedTable, how: Callable[[DataFrame, DataFrame], DataFrame], name: str, checkpoint: str):
    """Each batch merged into the buckets of a table that its keys fall into. The table's manifest names the last batch, so one that comes again changes nothing."""

    def write(batch: DataFrame, n: int) -> None:
        table.merge(batch, how, batch=(name, n))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
