"""Queries of tables that are stored and changed by key, over the shop's data, and their SQL.

Each makes a table in the shared folder, changes it as the reference's own tables are changed, and reads versions of it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import jobs, papers
from .queries import query, table
from .sources import readers
from .sources.tables import KeyedTable, Unique, shared_folder
from .streaming import leases

_LAST = """SELECT client_id, arg_max(struct_pack(op := op, source := source, segment := segment, city := city, balance := balance), (coalesce(valid_at, TIMESTAMP '1970-01-01'), seq, change_id)) AS x FROM client_changes GROUP BY client_id"""


@query(f"""
WITH c AS (SELECT client_id, x.* FROM ({_LAST})),
v AS (SELECT coalesce(o.client_id, c.client_id) AS client_id, o.client_id IS NOT NULL AS known, CASE WHEN o.client_id IS NULL THEN c.source ELSE o.source END AS source, coalesce(nullif(c.segment, ''), o.segment) AS segment, CASE WHEN o.client_id IS NULL THEN c.city ELSE coalesce(nullif(c.city, ''), o.city) END AS city,
    coalesce(c.balance, o.balance) AS balance FROM clients o FULL JOIN (SELECT * FROM c WHERE op <> 'D') c ON o.client_id = c.client_id
  WHERE coalesce(o.client_id, c.client_id) NOT IN (SELECT client_id FROM c WHERE op = 'D'))
SELECT coalesce(o.client_id, v.client_id) AS client_id, v.client_id IS NOT NULL AS stored, v.source, v.segment, v.city, v.balance, o.segment AS segment_before, o.city AS city_before, o.balance AS balance_before
FROM clients o FULL JOIN v ON o.client_id = v.client_id""")
def client_versions(spark, d):
    """Clients as a stored table, into which each client's last change is merged: the rows of both versions side by side."""
    columns = ("client_id", "source", "segment", "city", "balance")
    changes = table(spark, d, "client_changes").withColumn("at", F.struct(F.coalesce("valid_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "seq", "change_id"))
    last = papers.last_change(changes.select(*columns, "op", "at"), "client_id", "at").drop("at")
    stored = KeyedTable.create(spark, shared_folder(spark), table(spark, d, "clients").select(*columns), "client_id")

    def how(current, new):
        merged = papers.merge(current, new.where("op <> 'D'").drop("op"), "client_id", {"source": papers.keep, "segment": papers.nonblank_wins, "city": papers.nonblank_wins})
        return merged.join(new.where("op = 'D'").select("client_id"), "client_id", "left_anti")

    after = stored.merge(last, how)
    old = stored.read(0).select("client_id", *[F.col(c).alias(f"{c}_before") for c in columns[2:]])
    return stored.read(after).withColumn("stored", F.lit(True)).join(old, "client_id", "full").withColumn("stored", F.coalesce("stored", F.lit(False)))


_JOBS = """SELECT sale_id AS job_id, CASE status WHEN 'open' THEN 'queued' WHEN 'held' THEN 'retry' ELSE 'pr_open' END AS state, coalesce(priority, 0) AS attempt_count, 4 AS max_attempts, coalesce(sold_at, arrived_at) AS created_at, arrived_at AS next_run_at FROM sales"""
_NOW = "2024-03-01 00:00:00"


@query(f"""
WITH e AS (SELECT *, row_number() OVER (ORDER BY created_at, job_id) AS n FROM ({_JOBS}) WHERE attempt_count < max_attempts AND (state = 'queued' OR (state = 'retry' AND next_run_at <= TIMESTAMP '{_NOW}')))
SELECT job_id, CASE WHEN n <= 60 THEN 'w1' ELSE 'w2' END AS lease_owner, 'leased' AS state, attempt_count + 1 AS attempt_count, created_at, TIMESTAMP '{_NOW}' + INTERVAL 1 HOUR AS lease_expires_at FROM e WHERE n <= 100""")
def claimed_in_turn(spark, d):
    """Sales as stored jobs: what one worker claims, and then another one from what is left."""
    s, now = table(spark, d, "sales"), F.lit(_NOW).cast("timestamp_ntz")
    state = F.when(F.col("status") == "open", "queued").when(F.col("status") == "held", "retry").otherwise("pr_open")
    none = F.lit(None).cast("timestamp_ntz")
    rows = s.select(F.col("sale_id").alias("job_id"), state.alias("state"), F.coalesce("priority", F.lit(0)).alias("attempt_count"), F.lit(4).alias("max_attempts"), F.coalesce("sold_at", "arrived_at").alias("created_at"), F.col("arrived_at").alias("next_run_at"), none.alias("lease_expires_at"), F.lit(None).cast("string").alias("lease_owner"), F.col("arrived_at").alias("updated_at"))
    queue = KeyedTable.create(spark, shared_folder(spark), rows, "job_id")
    for worker, most in (("w1", 60), ("w2", 40)):
        jobs.claim_in(queue, worker, 3600, now, most)
    return queue.read().where("lease_owner IS NOT NULL").select("job_id", "lease_owner", "state", "attempt_count", "created_at", "lease_expires_at")


@query("""
WITH s AS (SELECT *, coalesce(sold_at < TIMESTAMP '2024-03-01', false) AS early FROM sales),
had AS (SELECT DISTINCT client_id FROM s WHERE early AND status = 'open' AND client_id IS NOT NULL), first AS (SELECT client_id, min(sale_id) AS first FROM s WHERE NOT early AND status = 'open' GROUP BY client_id)
SELECT s.sale_id, s.client_id, s.total FROM s JOIN first USING (client_id) WHERE NOT early AND status = 'open' AND (s.sale_id > first OR s.client_id IN (SELECT client_id FROM had))""")
def refused_appends(spark, d):
    """Sales stored under the rule that a client has one open sale: the later ones that an append refuses."""
    s = table(spark, d, "sales").withColumn("early", F.coalesce(F.col("sold_at") < F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), F.lit(False)))
    is_open = F.coalesce(F.col("status") == "open", F.lit(False)) & F.col("client_id").isNotNull()
    early = s.where("early")
    first = early.where(is_open).groupBy("client_id").agg(F.min("sale_id").alias("sale_id")).select("sale_id")
    rows = early.where(~is_open).unionByName(early.join(first, "sale_id", "left_semi")).drop("early")
    stored = KeyedTable.create(spark, shared_folder(spark), rows, "sale_id", unique=(Unique("client_id", "status = 'open'"),))
    return stored.append(s.where("not early").drop("early")).select("sale_id", "client_id", "total")


#: events' kinds as states of jobs.
_AS_STATE = {"signup": "queued", "click": "scraping", "view": "leased", "purchase": "pr_open", "error": "failed"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS_STATE.items()) + " ELSE 'retry' END"


@query(f"""
WITH e AS (SELECT DISTINCT ON (event_id) event_id, user_id AS job_id, ts, {_STATE_SQL} AS state FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT *, lead(ts) OVER w AS next, row_number() OVER w AS n, (SELECT max(ts) FROM e) AS latest FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
x AS (SELECT job_id, 'expired' AS what, state, ts, n FROM l WHERE state IN ('scraping', 'leased') AND CASE WHEN next IS NULL THEN ts + INTERVAL 2 HOUR < latest - INTERVAL 1 HOUR ELSE next > ts + INTERVAL 2 HOUR END
  UNION ALL SELECT job_id, 'state', state, ts, n FROM l WHERE next IS NULL)
SELECT job_id, what, state, epoch_us(ts)::BIGINT AS at, n AS n_events FROM x""")
def lease_timers(spark, d):
    """events as a stream of job events: each job's state, and the leases that ended unheard of, by timers on event time."""
    e = table(spark, d, "events")
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _AS_STATE.items() for x in kv]), F.col("event_type")), F.lit("retry"))
    # a pattern, as a stream takes no path of one file
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/event[s].parquet").where("user_id IS NOT NULL AND ts IS NOT NULL")
    folder = shared_folder(spark)
    leases.run_once(leases.watched(stream.select(F.col("user_id").alias("job_id"), "event_id", state.alias("to_state"), F.col("ts").alias("created_at")), seconds=7200), folder)
    return spark.read.parquet(f"{folder}/out")


@query("""
WITH b AS (SELECT source || '/' || doc_id || '.md' AS path, n_chars + CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS size, lang AS modified FROM documents WHERE n_chars % 5 > 0),
n AS (SELECT source || '/' || doc_id || '.md' AS path, n_chars AS size, CASE WHEN n_chars % 13 = 0 THEN NULL ELSE lang END AS modified FROM documents WHERE n_chars % 11 > 0)
SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' ELSE 'changed' END AS what FROM b FULL JOIN n ON b.path = n.path
WHERE b.path IS NULL OR n.path IS NULL OR b.size <> n.size OR b.modified IS DISTINCT FROM n.modified""")
def scan_snapshots(spark, d):
    """Documents as files of two scans, of which the first one is stored: what the second one finds new, changed or gone."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "n_chars", "lang").where("path is not null")
    n = F.col("n_chars")
    before = docs.where(n % 5 > 0).select("path", (n + F.when(n % 7 == 0, 1).otherwise(0)).alias("size"), F.col("lang").alias("modified"))
    now = docs.where(n % 11 > 0).select("path", n.alias("size"), F.when(n % 13 > 0, F.col("lang")).alias("modified"))
    return readers.rescan(KeyedTable.create(spark, shared_folder(spark), before, "path"), now)


@query("""
WITH l AS (SELECT doc_id, lang, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS t FROM l),
g AS (SELECT doc_id, any_value(lang) AS lang, any_value(n_chars) AS n, count(*) AS n_pages, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page) FILTER (t <> ''), '') AS body, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY page) FILTER (t <> '' AND page <= 3), '') AS preview FROM c GROUP BY doc_id),
s AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'https://x.org/' || doc_id || '.pdf' ELSE 'papers/' || lang || '/' || doc_id || '.pdf' END AS source, CASE WHEN n % 4 = 0 THEN '10.5555/' || n ELSE '' END AS doi FROM g)
SELECT source, CASE WHEN n % 3 = 0 THEN source WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE source END AS url, CASE WHEN n % 5 = 0 THEN 'On ' || lang ELSE coalesce(list_filter(string_split(preview, chr(10)), lambda x: length(trim(x)) >= 8)[1], doc_id::VARCHAR) END AS title, doi, md5(preview) AS preview, md5(body) AS body, n_pages::INT AS n_pages FROM s""")
def pdf_pages(spark, d):
    """Lines of documents as pages of PDF texts: the packet of each, with its preview, and the title and DOI that metadata or preview have."""
    n = F.col("n_chars")
    source = F.when(n % 3 == 0, F.concat(F.lit("https://x.org/"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(F.concat(F.lit("papers/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    pages = table(spark, d, "documents").where("text is not null").select(source.alias("source"), F.posexplode(F.split("text", "\n")).alias("page", "text"), F.when(n % 5 == 0, F.concat(F.lit("On "), "lang")).alias("meta_title"), F.lit(None).cast("string").alias("meta_author"), F.when(n % 4 == 0, F.concat(F.lit("doi:10.5555/"), n.cast("string"), F.lit("."))).alias("meta_subject"))
    found = readers.pdf_packets(pages)
    return found.select("source", "url", "title", "doi", F.md5(F.col("preview").cast("binary")).alias("preview"), F.md5(F.col("body_markdown").cast("binary")).alias("body"), "n_pages")
