"""Streaming forms end where the batch forms do."""

import datetime as dt

from pyspark.sql import functions as F

from papertide.operators import jobs
from papertide.streaming import events

T0 = dt.datetime(2024, 1, 1)
ROWS = [(i, i % 3, s, T0 + dt.timedelta(minutes=m)) for i, (s, m) in enumerate([("queued", 0), ("queued", 1), ("queued", 2), ("leased", 5), ("leased", 4), ("failed", 9), ("retry", 3), ("validated", 8), ("scraping", 7)])]


def stream(spark, folder, rows, schema):
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_fold(spark, tmp_path):
    schema = "event_id long, job_id long, to_state string, created_at timestamp"
    source = stream(spark, tmp_path / "in", ROWS, schema)
    q = events.folded(source).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in sorted(spark.table("folded").collect(), key=lambda r: r.n_events):
        last[r.job_id] = (r.state, r.n_events)
    want = {r.job_id: (r.state, r.n_events) for r in jobs.fold(spark.createDataFrame(ROWS, schema)).collect()}
    assert last == want


def test_merging_and_duplicates(spark, tmp_path):
    schema = "message_id string, imported_at timestamp, v int"
    rows = [("a", T0, 1), ("b", T0, 1), ("a", T0, 1), ("a", T0, 1), ("c", T0 + dt.timedelta(hours=1), 2), ("b", T0, 1)]
    source = events.deduplicated(stream(spark, tmp_path / "in", rows, schema))
    merge = lambda before, batch: batch if before is None else before.unionAll(batch)
    q = events.merging(source, str(tmp_path / "out"), merge, str(tmp_path / "c"))
    q.awaitTermination(120)
    newest = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    got = spark.read.parquet(str(tmp_path / "out" / f"v={newest}")).select("message_id").collect()
    assert sorted(r.message_id for r in got) == ["a", "b", "c"]


def test_windows(spark, tmp_path):
    source = stream(spark, tmp_path / "in", ROWS, "event_id long, job_id long, to_state string, created_at timestamp")
    q = events.events_per_window(source, "created_at", "to_state").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == len(ROWS)


def test_repeated_events_count_once(spark, tmp_path):
    schema = "event_id long, job_id long, to_state string, created_at timestamp"
    source = stream(spark, tmp_path / "in", ROWS + ROWS[:3], schema)
    q = events.folded(source).writeStream.outputMode("update").format("memory").queryName("folded_again").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(r.n_events for r in spark.table("folded_again").collect()) == 3
