"""Stored tables: versions, merges of few buckets, one winner of concurrent claims, uniqueness, batches that come again."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from papertide.operators import jobs, papers
from papertide.sources import readers, tables
from papertide.sources.tables import Conflict, KeyedTable, NotUnique, Unique, shared_folder
from papertide.streaming import events

NOW = "2024-03-01 00:00:00"
ROW = "job_id long, source_url string, state string"


def how(current, changes):
    return papers.merge(current, changes, "job_id", {})


def stored(spark, rows, n=32, **more):
    return KeyedTable.create(spark, shared_folder(spark), rows, "job_id", n, **more)


@pytest.fixture
def urls(spark):
    return spark.range(400).select(F.col("id").alias("job_id"), F.concat(F.lit("u"), "id").alias("source_url"), F.lit("queued").alias("state")).repartition(3)


def test_a_merge_rewrites_its_buckets_only(spark, urls):
    t = stored(spark, urls)
    assert t.merge(spark.createDataFrame([(7, None, "leased")], ROW), how) == 1
    assert t.changed_files(0, 1) == 1 / 32 < 0.05
    assert t.merge(spark.createDataFrame([(7, "v7", None), (1000, "n", "queued")], "job_id int, source_url string, state string"), how) == 2
    assert t.versions() == [0, 1, 2]
    of = lambda v: {r.job_id: (r.source_url, r.state) for r in t.read(v).where("job_id in (7, 8, 1000)").collect()}
    assert of(0) == {7: ("u7", "queued"), 8: ("u8", "queued")}
    assert of(1) == {7: ("u7", "leased"), 8: ("u8", "queued")} and of(2) == {7: ("v7", "leased"), 8: ("u8", "queued"), 1000: ("n", "queued")}
    assert [t.read(v).count() for v in (0, 1, 2)] == [400, 400, 401] == [sum(t.manifest(v).rows) for v in (0, 1, 2)]
    # a look-up by key reads the bucket of the key
    one = t.read(keys=spark.createDataFrame([(7,)], "job_id int"))
    assert one.where("job_id = 7").count() == 1 and len(one.inputFiles()) == 1 < len(t.read().inputFiles())
    assert t.breaches().isEmpty()
    backup = t.copied(shared_folder(spark), 1)
    assert sorted(map(tuple, backup.read().collect())) == sorted(map(tuple, t.read(1).collect()))
    assert t.drop_versions(1) >= 1 and t.versions() == [2] and t.read().count() == 401


def test_versions_are_published_once(spark, urls):
    t = stored(spark, urls, 4)
    t.files.create("000000000001.json", t.manifest().text())
    with pytest.raises(Conflict):
        t.files.create("000000000001.json", "{}")
    assert not [x for x in t.files.names() if x.startswith(".")]


def test_writers_of_other_buckets_both_stand(spark, urls):
    t = stored(spark, urls)
    base, of = t.manifest(), {}
    for k in range(40):
        of.setdefault(next(iter(t._buckets_of(base, spark.createDataFrame([(k,)], "job_id long")))), k)
        if len(of) == 2:
            break
    a, b = of.values()
    change = lambda k: spark.createDataFrame([(k, f"w{k}", "leased")], ROW)
    once = []

    def slow(current, changes):
        if not once:  # another writer comes between reading and publishing
            once.append(t.merge(change(b), how))
        return how(current, changes)

    assert t.merge(change(a), slow) == 2 and len(once) == 1
    assert {r.job_id for r in t.read().where("state = 'leased'").collect()} == {a, b}
    again = []

    def same(current, changes):
        again.append(1)
        if len(again) == 1:
            t.merge(spark.createDataFrame([(a, "theirs", "done")], ROW), how)
        return how(current, changes.drop("source_url").withColumn("source_url", F.lit(None).cast("string")))

    assert t.merge(change(a), same) == 4 and len(again) == 2  # done again over the other's row
    assert t.read().where(f"job_id = {a}").first().source_url == "theirs"


def test_of_four_claimers_one_gets_each_job(spark):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = spark.range(30).select(F.col("id").alias("job_id"), F.lit("queued").alias("state"), F.lit(0).alias("attempt_count"), F.lit(3).alias("max_attempts"), (stamp + F.make_dt_interval(days=(30 - F.col("id")).cast("int"))).alias("created_at"), stamp.alias("next_run_at"), F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"), F.lit(None).cast("string").alias("lease_owner"), stamp.alias("updated_at"))
    t = stored(spark, rows, 4)

    def work(worker):
        own = KeyedTable(spark, t.path)
        return [r.job_id for _ in range(2) for r in jobs.claim_in(own, worker, 3600, F.lit(NOW).cast("timestamp_ntz"))]

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(work, ["w1", "w2", "w3", "w4"]))
    assert sorted(x for xs in got for x in xs) == list(range(22, 30))  # the oldest eight, each once
    held = {r.job_id: r.lease_owner for r in t.read().where("lease_owner is not null").collect()}
    assert held == {x: f"w{i + 1}" for i, xs in enumerate(got) for x in xs}
    assert jobs.claim_in(t, "w5", 60, F.lit("2023-01-01 00:00:00").cast("timestamp_ntz"), 0) == []


def test_uniqueness_is_kept(spark, urls):
    t = stored(spark, urls, unique=jobs.ONE_ACTIVE[1:2])
    new = [(500, "u7", "queued"), (501, "fresh", "queued"), (502, "fresh", "queued"), (503, "u8", "failed"), (504, "", "queued"), (505, None, "queued"), (6, "mine", "queued"), (None, "x", "queued")]
    refused = t.append(spark.createDataFrame(new, ROW))
    assert sorted(r.source_url for r in refused.collect()) == ["fresh", "mine", "u7", "x"]
    assert {r.job_id for r in t.read().where("job_id > 400").collect()} == {501, 503, 504, 505}
    # a stopped job frees its url; then it is another's, and can't come back
    t.merge(spark.createDataFrame([(7, None, "failed")], ROW), how)
    assert t.append(spark.createDataFrame([(600, "u7", "queued")], ROW)).isEmpty()
    with pytest.raises(NotUnique, match="u7"):
        t.merge(spark.createDataFrame([(7, None, "queued")], ROW), how)
    with pytest.raises(NotUnique):
        stored(spark, urls.unionAll(urls))
    assert jobs.breaches(t.read().withColumns({"article_key": F.lit(None).cast("string"), "canonical_source_url": F.lit(None).cast("string")})).isEmpty()


def test_two_writers_of_one_url(spark, urls):
    t = stored(spark, urls, unique=jobs.ONE_ACTIVE[1:2])
    put = lambda k: sorted(r.job_id for r in KeyedTable(spark, t.path).append(spark.createDataFrame([(k, "same", "queued")], ROW)).collect())
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(put, [701, 702]))
    assert sorted(map(len, got)) == [0, 1] and t.read().where("source_url = 'same'").count() == 1


def test_filters_spare_reads(spark, urls):
    t = stored(spark, urls, unique=jobs.ONE_ACTIVE[1:2])
    m, u = t.manifest(), t.manifest().unique[0]
    fresh = spark.range(1000, 1020).select(F.concat(F.lit("f"), "id").alias("value"), F.col("id").alias("key"))
    held, asked = t._held(m, u, fresh)
    assert held.isEmpty() and len(held.inputFiles()) <= 3 < len(asked)
    known = spark.range(0, 400).select(F.concat(F.lit("u"), "id").alias("value"), F.col("id").alias("key"))
    assert t._held(m, u, known)[0].count() == 400  # none is ever missed


def test_filter_size(spark):
    values = spark.range(5000).select((F.col("id") % 3).cast("int").alias("__bucket"), F.col("id").cast("string").alias("value"))
    found = tables.bloom(values)
    ask = spark.range(5000, 15_000).select((F.col("id") % 3).cast("int").alias("b"), F.col("id").cast("string").alias("value"))
    wrong = ask.join(found, F.col("b") == F.col("__bucket")).where(tables.may_hold("value")).count()
    right = values.withColumnRenamed("__bucket", "b").join(found, F.col("b") == F.col("__bucket")).where(tables.may_hold("value")).count()
    assert right == 5000 and wrong < 200


def test_batches_come_once(spark, urls, tmp_path):
    t = stored(spark, urls)
    for i, k in enumerate((3, 4)):
        spark.createDataFrame([(k, None, "leased"), (900 + k, f"n{k}", "queued")], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")
        events.merging_into(stream, t, how, "jobs", f"{tmp_path}/at").awaitTermination()
        assert t.manifest().applied == {"jobs": i}
    before = t.manifest()
    assert t.merge(spark.createDataFrame([(5, None, "failed")], ROW), how, batch=("jobs", 1)) == before.version and t.manifest() == before
    assert {r.job_id for r in t.read().where("state = 'leased' or job_id > 400").collect()} == {3, 4, 903, 904}


def test_no_rows(spark, urls):
    t = stored(spark, urls.limit(0), 4, unique=jobs.ONE_ACTIVE[1:2])
    assert t.read().isEmpty() and t.append(urls.limit(0)).isEmpty() and t.append(urls.limit(2)).isEmpty() and t.read().count() == 2


def test_rescan(spark):
    files = "path string, modified long, size long, title string"
    t = KeyedTable.create(spark, shared_folder(spark), spark.createDataFrame([("a", 1, 1, "A"), ("b", 1, 1, "B"), ("c", None, 1, "C"), ("d", 1, 1, "D")], files), "path", 4)
    now = spark.createDataFrame([("a", 1, 1, "A"), ("b", 2, 1, "B2"), ("c", None, 1, "C"), ("e", 1, 1, "E")], files)
    assert sorted(map(tuple, readers.rescan(t, now).collect())) == [("b", "changed"), ("d", "gone"), ("e", "new")]
    assert sorted(map(tuple, t.read().collect())) == sorted(map(tuple, now.collect())) and t.versions() == [0, 1]
    assert readers.rescan(t, now).collect() == []


def test_pdf_packets(spark):
    rows = [("p/x.v2.pdf", 2, "Methods\n\n\n\nused  here", None), ("p/x.v2.pdf", 1, " short\r\nA title of it\tall \nAbstract: We saw it. Keywords: tea; sleep\n\nIntroduction", None), ("p/x.v2.pdf", 3, " ", None), ("p/x.v2.pdf", 4, "late 10.5555/late", None), ("http://h.org/y.pdf", 1, None, "DOI 10.5555/sub.")]
    got = {r.source: r for r in readers.pdf_packets(spark.createDataFrame(rows, "source string, page int, text string, meta_subject string").withColumns({"meta_title": F.lit(None).cast("string"), "meta_author": F.lit(" Lee  K")})).collect()}
    x, y = got["p/x.v2.pdf"], got["http://h.org/y.pdf"]
    assert (x.title, x.authors, x.doi, x.url, x.abstract, x.keywords, x.n_pages) == ("A title of it all", "Lee K", "", "p/x.v2.pdf", "We saw it.", "tea; sleep", 4)
    assert x.body_markdown.endswith("Methods\n\nused here\n\nlate 10.5555/late") and "late" not in x.preview
    assert (y.title, y.doi, y.url, y.body_markdown) == ("y", "10.5555/sub", "http://h.org/y.pdf", "")
