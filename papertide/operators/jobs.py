"""The publication queue as a fold over its events, and the rules for queueing, claiming and retrying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import or_null
from ..functions.values import JOB_STATES, STOPPED, TERMINAL, backoff_seconds
from ..sources.tables import KeyedTable, Unique
from .intake import STARTED, find_articles, keep_first, without_jobs

REQUEUED_FROM = ("validated", "needs_review", "failed", "rejected")


def fold(events: DataFrame, job: str = "job_id", state: str = "to_state", at: str = "created_at", event: str = "event_id") -> DataFrame:
    """The state of each job: its last event's, how many it had, when it began and last changed. Combines before the exchange."""
    order = F.struct(at, event)
    return events.groupBy(job).agg(F.max_by(state, order).alias("state"), F.count("*").alias("n_events"), F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count_if(F.col(state) == "leased").alias("attempt_count"))


def transitions(events: DataFrame, job: str, state: str, at: str, event: str) -> DataFrame:
    """Each event with the state before it."""
    return events.withColumn("from_state", F.lag(state).over(W.partitionBy(job).orderBy(at, event)))


def running_state(events: DataFrame, rank: Column, job: str, at: str, event: str) -> DataFrame:
    """Each event with the highest rank so far: states only rise."""
    return events.withColumn("rank", F.max(rank).over(W.partitionBy(job).orderBy(at, event).rowsBetween(W.unboundedPreceding, 0)))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that a worker may take: queued, due for another try, or left by a worker whose lease ended; with tries left."""
    waiting = F.col("state") == "queued"
    due = (F.col("state") == "retry") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))
    left = ~F.col("state").isin(*STOPPED) & F.coalesce(F.col("lease_expires_at") <= now, F.lit(False))
    return jobs.where((F.col("attempt_count") < F.col("max_attempts")) & (waiting | due | left))


def oldest(jobs: DataFrame, now: Column, most: int = 1) -> DataFrame:
    return claimable(jobs, now).orderBy("created_at", "job_id").limit(most)


def leased(jobs: DataFrame, worker: str, lease_seconds: int, now: Column) -> DataFrame:
    """Jobs as a worker has taken them."""
    if not worker.strip() or lease_seconds < 60:
        raise ValueError("a worker's name and a lease of 60 seconds at least")
    return jobs.withColumns({"state": F.lit("leased"), "attempt_count": F.col("attempt_count") + 1, "lease_owner": F.lit(worker), "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease_seconds)), "updated_at": now, "next_run_at": F.lit(None).cast(jobs.schema["next_run_at"].dataType)})


def claim(jobs: DataFrame, worker: str, lease_seconds: int, now: Column) -> DataFrame:
    """The oldest claimable job as leased. One writer must apply it; of several, claim_in() lets one win."""
    return leased(oldest(jobs, now), worker, lease_seconds, now)


#: What no two active jobs of a table may have in common.
ONE_ACTIVE = tuple(Unique(c, f"state NOT IN ({', '.join(map(repr, TERMINAL))})") for c in ("article_key", "source_url", "canonical_source_url"))


def claim_in(table: KeyedTable, worker: str, lease_seconds: int, now: Column, most: int = 1) -> list[Row]:
    """The oldest claimable jobs of a table, which this worker now holds and no other one: one job, or as many as are asked for."""
    return table.update_first(lambda jobs: oldest(jobs, now, most), lambda jobs: leased(jobs, worker, lease_seconds, now))


def set_state(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(job_id, state, worker): leases of others and unknown states are refused, retries wait longer each time."""
    df = jobs.join(changes.select("job_id", F.col("state").alias("__state"), F.col("worker").alias("__worker")), "job_id", "left")
    ok = F.col("__state").isin(*JOB_STATES) & (or_null("__worker").isNull() | F.col("lease_owner").isNull() | (F.col("__worker") == F.col("lease_owner")))
    to, change = F.col("__state"), F.coalesce(ok, F.lit(False))
    wait = now + F.make_dt_interval(secs=backoff_seconds("attempt_count"))
    null = lambda c: F.lit(None).cast(jobs.schema[c].dataType)
    done = to.isin(*STOPPED)
    sets = {
        "state": F.when(change, to).otherwise(F.col("state")),
        "updated_at": F.when(change, now).otherwise(F.col("updated_at")),
        "lease_owner": F.when(change & ((to == "retry") | done), null("lease_owner")).otherwise(F.col("lease_owner")),
        "lease_expires_at": F.when(change & ((to == "retry") | done), null("lease_expires_at")).otherwise(F.col("lease_expires_at")),
        "next_run_at": F.when(change & (to == "retry"), wait).when(change, null("next_run_at")).otherwise(F.col("next_run_at")),
        "finished_at": F.when(change & done, now).when(change & (to == "retry"), null("finished_at")).otherwise(F.col("finished_at")),
    }
    return df.withColumns(sets).select(jobs.columns)


def state_events(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The log rows of set_state(): job_id, from_state, to_state, created_at, of the changes that it takes."""
    old = jobs.select("job_id", F.col("state").alias("from_state"), "lease_owner")
    df = changes.select("job_id", F.col("state").alias("to_state"), "worker").join(old, "job_id")
    ok = F.col("to_state").isin(*JOB_STATES) & (or_null("worker").isNull() | F.col("lease_owner").isNull() | (F.col("worker") == F.col("lease_owner")))
    return df.where(ok).select("job_id", "from_state", "to_state", now.alias("created_at"))


#: What a requeued job loses; its log row keeps it.
OUTPUTS = ("run_id", "packet_path", "target_path", "branch", "commit_sha", "pr_url")


def requeue_events(jobs: DataFrame, ids_: DataFrame, reason: str, now: Column) -> DataFrame:
    """The log rows of requeue(): with the reason and the outputs that are cleared."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    kept = [c for c in OUTPUTS if c in jobs.columns]
    prior = F.map_filter(F.create_map(*[x for c in kept for x in (F.lit(c), or_null(c))]), lambda k, v: v.isNotNull()) if kept else F.create_map().cast("map<string,string>")
    detail = F.to_json(F.struct(F.lit("explicit_requeue").alias("action"), F.lit(reason.strip()).alias("reason"), prior.alias("prior_outputs")))
    hit = jobs.join(ids_.select("job_id"), "job_id", "left_semi").where(F.col("state").isin(*REQUEUED_FROM))
    return hit.select("job_id", F.col("state").alias("from_state"), F.lit("queued").alias("to_state"), detail.alias("detail_json"), now.alias("created_at"))


def requeue(jobs: DataFrame, ids_: DataFrame, now: Column) -> DataFrame:
    """Stopped jobs back to the queue, with their tries anew; others stay as they are."""
    df = jobs.join(ids_.select("job_id").distinct().withColumn("__hit", F.lit(True)), "job_id", "left")
    hit = F.coalesce(F.col("__hit") & F.col("state").isin(*REQUEUED_FROM), F.lit(False))
    cleared = {c: F.when(hit, F.lit(None).cast(jobs.schema[c].dataType)).otherwise(F.col(c)) for c in ("lease_owner", "lease_expires_at", "next_run_at", *OUTPUTS, "result_json", "error", "started_at", "finished_at") if c in jobs.columns}
    return df.withColumns({"attempt_count": F.when(hit, 0).otherwise(F.col("attempt_count")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), **cleared, "state": F.when(hit, "queued").otherwise(F.col("state"))}).select(jobs.columns)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `n`, their place from 1 in the order of a text key: by the key's first characters, and what comes before those."""
    rows = rows.withColumn("__start", F.substring(key, 1, 3))
    # a row for each start: of keys that are digests 4,096
    starts = rows.groupBy("__start").agg(F.count("*").alias("__many"))
    before = starts.select("__start", (F.sum("__many").over(W.orderBy("__start")) - F.col("__many")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__start").orderBy(key))
    return rows.withColumn("__inside", inside).join(before, "__start").withColumn("n", F.col("__before") + F.col("__inside")).drop("__start", "__inside", "__before")


def enqueue(articles: DataFrame, jobs: DataFrame, probes: DataFrame, domain: str, max_attempts: int = 3) -> DataFrame:
    """probes(identifier): a new job for each article found that has a url, unless an active job has its key, url or canonical url; then that job, the newest one.

    job_id, created, article_key, source_url, canonical_source_url, domain, state, max_attempts. Of articles with one canonical url that come together the first gets the job.
    """
    found = find_articles(articles, probes).dropDuplicates(["article_key"])
    df = found.withColumn("source_url", F.trim(F.coalesce(or_null("article_url"), or_null("scholar_url"), F.lit("")))).where("source_url <> ''").withColumn("canonical_source_url", ids.canonical_url("source_url"))
    tags = lambda *xs: F.explode(F.array_distinct(F.array_compact(F.array(*[F.when(x.isNotNull(), F.concat(F.lit(t), x.cast("string"))) for t, x in xs])))).alias("tag")
    names = ("k:", F.col("article_key")), ("u:", F.col("source_url")), ("c:", F.col("canonical_source_url"))
    open_ = jobs.where(~F.col("state").isin(*TERMINAL)).withColumn("canonical_source_url", F.coalesce("canonical_source_url", ids.canonical_url("source_url")))
    have = open_.select("job_id", "state", "max_attempts", tags(*names))
    met = df.select("article_key", tags(*names)).join(have, "tag").groupBy("article_key").agg(F.max(F.struct("job_id", "state", "max_attempts")).alias("job"))
    df = df.join(met, "article_key", "left")
    rest = [F.lit(domain).alias("domain")]
    old = df.where("job is not null").select("job.job_id", F.lit(False).alias("created"), "article_key", "source_url", "canonical_source_url", *rest, "job.state", "job.max_attempts")
    new = keep_first(df.where("job is null"), F.col("canonical_source_url"), [F.col("article_key")])
    last = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0))).scalar()
    fresh = numbered(new, "article_key").select((last + F.col("n")).alias("job_id"), F.lit(True).alias("created"), "article_key", "source_url", "canonical_source_url", *rest, F.lit("queued").alias("state"), F.lit(max_attempts).alias("max_attempts"))
    return old.unionAll(fresh)


def enqueue_backlog(articles: DataFrame, papers: DataFrame, jobs: DataFrame, status: str, domain: str, min_score: int, limit: int) -> DataFrame:
    """Articles to queue: never queued before, one for each source, best first; with new job ids."""
    df = articles.where((F.col("status") == status) & (F.col("domain") == domain) & (F.col("score") >= min_score) & F.col("processed_at").isNull())
    df = df.join(papers.select("paper_key", "workflow_state"), "paper_key", "left").where(~F.coalesce("workflow_state", F.lit("discovered")).isin(*STARTED))
    df = without_jobs(df, jobs).withColumn("source_url", F.trim(F.coalesce(or_null("article_url"), or_null("scholar_url")))).where("source_url <> ''").withColumn("canonical_source_url", ids.canonical_url("source_url"))
    order = [F.desc("score"), F.col("created_at").asc(), F.col("article_key").asc()]
    df = keep_first(df, F.col("canonical_source_url"), order)
    open_ = jobs.where(~F.col("state").isin(*TERMINAL)).select(F.explode(F.array_distinct(F.array(ids.canonical_url("source_url"), F.coalesce("canonical_source_url", ids.canonical_url("source_url"))))).alias("canonical_source_url")).distinct()
    chosen = df.join(open_, "canonical_source_url", "left_anti").orderBy(*order).limit(limit)
    last = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0))).scalar()
    # no more rows than the limit are numbered here
    return chosen.select((last + F.row_number().over(W.orderBy(*order))).alias("job_id"), "article_key", "source_url", "canonical_source_url", "domain", F.lit("queued").alias("state"))


def with_articles(jobs: DataFrame, articles: DataFrame) -> DataFrame:
    """Jobs with the title, score and status of their article; jobs without one are left out."""
    return jobs.join(articles.select("article_key", "title", "score", F.col("status").alias("article_status")), "article_key")


def not_unique(jobs: DataFrame, key: str) -> DataFrame:
    """Keys that more than one active job has."""
    return jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(~F.col("state").isin(*TERMINAL)).alias("active")).where("active > 1")


def breaches(jobs: DataFrame) -> DataFrame:
    """What more than one active job has of what one may have only: name, value, active."""
    active = jobs.where(~F.col("state").isin(*TERMINAL))
    names = ("article_key", "source_url", "canonical_source_url")
    rows = active.select(F.explode(F.array_compact(F.array(*[F.when(or_null(F.col(c).cast("string")).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))) for c in names]))).alias("x"))
    return rows.groupBy("x.name", "x.value").agg(F.count("*").alias("active")).where("active > 1")


def outcome(log: Column, exit_code: Column) -> Column:
    """Struct of state and pr_url: completed only with exit code 0 and a pull request printed, the last one counting."""
    urls = F.regexp_extract_all(log, F.lit(r"https://github\.com/[^\s/]+/[^\s/]+/pull/\d+"), F.lit(0))
    url = F.try_element_at(urls, F.lit(-1))
    return F.struct(F.when((exit_code == 0) & url.isNotNull(), "completed").otherwise("failed").alias("state"), url.alias("pr_url"))
