"""Jobs as state behind timers: what each job's events come to, and the leases from which nothing was heard in time.

A job's state is its last event and how many it had, in a RocksDB store; it can begin with what a batch fold of older events has found. A lease sets
a timer on event time, the next event of the job moves or removes it, and a job that has stopped is forgotten after some days. Events of one batch
are taken in order of time, those of later batches that are older than a job's last one count without moving it; so an expiry between two
events of a batch is found as one between batches is, and repeated reads of an event within the watermark count once.

Rows out: job_id, what ("state" for what the events of a batch have come to, "expired" for a lease), state, at (of the last event, or of the lease), n_events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import STOPPED

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States that no worker holds.
FREE = (*STOPPED, "queued", "retry")
_OUT = "job_id long, what string, state string, at long, n_events long"


class Leases(StatefulProcessor):
    def __init__(self, seconds: int, forget_days: int) -> None:
        self.lease, self.forget = seconds * 1_000_000, forget_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, event long, state string, n long")

    def _watch(self, at: int, state: str) -> None:
        """One timer for a job: when its lease ends, or when it may be forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state not in FREE:
            self.handle.registerTimer((at + self.lease) // 1000)
        elif state in STOPPED:
            self.handle.registerTimer((at + self.forget) // 1000)

    def _row(self, key: tuple, what: str, state: str, at: int, n: int) -> dict:
        return {"job_id": key[0], "what": what, "state": state, "at": at, "n_events": n}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, event, state, n = self.last.get() if self.last.exists() else (None, -1, "", 0)
        found = []
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])  # a job's events of one batch
        for t, e, s in zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["to_state"].tolist(), strict=True):
            n += 1
            if at is not None and (t, e) <= (at, event):
                continue
            if at is not None and state not in FREE and t > at + self.lease:
                found.append(self._row(key, "expired", state, at, n - 1))
            at, event, state = t, e, s
        self.last.update((at, event, state, n))
        self._watch(at, state)
        yield pd.DataFrame([*found, self._row(key, "state", state, at, n)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            at, event, state, n = self.last.get()
            if state in STOPPED:
                self.last.clear()
            else:
                self.last.update((at, event, "queued", n))  # free for another worker; heard of once
                yield pd.DataFrame([self._row(key, "expired", state, at, n)])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for at, event, state, n in initialState[["at", "event", "state", "n"]].itertuples(index=False):
            self.last.update((int(at), int(event), str(state), int(n)))
            self._watch(int(at), str(state))

    def close(self) -> None:
        pass


def watched(events: DataFrame, seconds: int = 3600, late: str = "1 hour", forget_days: int = 30, known: DataFrame | None = None) -> DataFrame:
    """events, a stream of (job_id, event_id, to_state, created_at). known: (job_id, at, event, state, n) of earlier events, as known_jobs() gives them."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_id"])
    source = timed.select(F.col("job_id").cast("long").alias("job_id"), "event_id", "to_state", "created_at", F.unix_micros("created_at").alias("at"))
    first = known.groupBy("job_id") if known is not None else None
    return source.groupBy("job_id").transformWithStateInPandas(Leases(seconds, forget_days), _OUT, "append", "eventTime", first)


def known_jobs(events: DataFrame) -> DataFrame:
    """What a batch of events comes to, as state to begin with."""
    order = F.struct(F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("event_id").alias("event"))
    one = events.dropDuplicates(["event_id"]).groupBy(F.col("job_id").cast("long").alias("job_id")).agg(F.max(order).alias("o"), F.max_by("to_state", order).alias("state"), F.count("*").alias("n"))
    return one.select("job_id", "o.at", "o.event", "state", "n")


def run_once(rows: DataFrame, folder: str) -> None:
    """All that a stream has now, written to folder/out, its progress to folder/at."""
    spark: SparkSession = rows.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)  # a query keeps the settings that it started with
    try:
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    query.awaitTermination()
