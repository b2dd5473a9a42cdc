"""Queries over the driver's tables, one or more for each group of operators, and their SQL.

Where a table of the data stands for one of the domain (articles, papers, jobs, pages), the binding is named in the
query. Lexicons and patterns are parameters of the operators, so queries use words that the data holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import classify, ids, text, udfs, values
from .operators import catalog, intake, jobs, packets, papers, verbatim
from .sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL that several queries share: a url's host and canonical form, and normalized text.
_URL = "'^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?'"
_NETLOC = f"regexp_extract(trim(url), {_URL}, 2)"
_HOST_WWW = f"lower(regexp_replace(regexp_replace({_NETLOC}, '^.*@', ''), ':[0-9]*$', ''))"
_HOST = f"regexp_replace({_HOST_WWW}, '^www\\.', '')"
_PATH = f"regexp_extract(trim(url), {_URL}, 3)"
_CANONICAL = f"CASE WHEN {_NETLOC} <> '' THEN 'https://' || {_HOST} || regexp_replace(regexp_replace(regexp_replace({_PATH}, ';[^/]*$', ''), '/{{2,}}', '/', 'g'), '/+$', '') ELSE lower(trim(url)) END"
_TITLE = "regexp_replace(trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), ' +$', '')"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _title():
    return F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), r"\s+", " "))


@query(f"""
WITH p AS (SELECT page_id, {_TITLE} AS title, {_CANONICAL} AS canonical_url,
             lower(regexp_replace(regexp_extract(coalesce(url, ''), '(?i)\\b10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+\\b', 0), '[).,;]+$', '')) AS doi,
             CASE WHEN contains({_HOST_WWW}, 'pubmed.ncbi.nlm.nih.gov') THEN regexp_extract({_PATH}, '/([0-9]{{5,10}})/?$', 1) ELSE '' END AS pmid
           FROM pages),
b AS (SELECT *, CASE WHEN doi <> '' THEN 'doi:' || doi WHEN pmid <> '' THEN 'pmid:' || pmid WHEN canonical_url <> '' THEN 'url:' || canonical_url ELSE 'title:' || {_key('title')} END AS basis FROM p)
SELECT sha256(basis) AS paper_key, canonical_url, count(*) AS n_pages, min(page_id) AS first_page, arg_min(title, page_id) AS title
FROM b GROUP BY ALL""")
def page_identity(spark, d):
    """Pages as papers: canonical url, identity key, and the first page of each."""
    p = table(spark, d, "pages").select("page_id", "url", _title().alias("title"))
    p = p.select("page_id", "title", ids.paper_key("title", "url").alias("paper_key"), ids.canonical_url("url").alias("canonical_url"))
    return p.groupBy("paper_key", "canonical_url").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.min_by("title", "page_id").alias("title"))


@query(f"""
SELECT page_id, {_HOST} AS host,
  ({_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org')) AS in_domain,
  (coalesce(url, '') = '' OR contains({_HOST_WWW}, 'blog')) AS has_source,
  ({_HOST_WWW} = 'example.com' OR ends_with({_HOST_WWW}, '.example.com')) AS by_pattern,
  regexp_matches(url, '(?i)^[^?#]*\\.pdf(?:[?#].*)?$') AS pdf, regexp_matches(trim(url), '(?i)^https?://[^/?#\\s]+') AS http
FROM pages""")
def page_host_filter(spark, d):
    """Host tests: membership in a domain, a part of the host, a wildcard pattern, and shapes of urls."""
    return table(spark, d, "pages").select("page_id", ids.host("url").alias("host"), ids.host_in("url", ("example.org",)).alias("in_domain"), ids.host_contains("url", "blog").alias("has_source"), ids.host_matches(ids.host("url", keep_www=True), "*.example.com").alias("by_pattern"), ids.looks_like_pdf("url").alias("pdf"), ids.valid_http_url("url").alias("http"))


@query(f"""
WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages), k AS (SELECT *, {_key('title')} AS normalized FROM t),
v AS (SELECT normalized, title, count(*) AS n FROM k GROUP BY ALL)
SELECT normalized, sum(n)::BIGINT AS total, count(*) AS variants, first(title ORDER BY n DESC, lower(title), title) AS canonical FROM v GROUP BY normalized""")
def page_title_groups(spark, d):
    """Titles that differ only in case and punctuation, with the most frequent spelling."""
    t = table(spark, d, "pages").select(_title().alias("title")).withColumn("normalized", text.key("title"))
    v = t.groupBy("normalized", "title").agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("o"), F.lower("title").alias("l"), "title"))
    return v.groupBy("normalized").agg(F.sum("n").alias("total"), F.count("*").alias("variants"), first["title"].alias("canonical"))


_LEXICON = {"the": 3, "that": 2, "with": 4, "tion": 1, "que": -2, "und": -3, "los": -4}
_SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in _LEXICON.items())
_REASONS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{'+' if w > 0 else ''}{w}:{t}' END" for t, w in _LEXICON.items()) + ", CASE WHEN n >= 4 THEN '+2:multi-author' WHEN n >= 2 THEN '+1:team-authored' WHEN n = 1 THEN '-2:single-author' END], lambda x: x IS NOT NULL)"
_AUTHORS = "CASE WHEN coalesce(first_line, '') = '' THEN NULL WHEN contains(first_line, ',') THEN len(list_filter(string_split(first_line, ','), lambda x: trim(x) <> '')) WHEN contains(lower(first_line), ' and ') THEN len(list_filter(regexp_split_to_array(first_line, '(?i)\\band\\b'), lambda x: trim(x) <> '')) ELSE 1 END"


@query(f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS first_line FROM documents), a AS (SELECT *, {_AUTHORS} AS n FROM l),
s AS (SELECT *, {_SCORE} + CASE WHEN n >= 4 THEN 2 WHEN n >= 2 THEN 1 WHEN n = 1 THEN -2 ELSE 0 END AS score FROM a)
SELECT doc_id, n::INT AS authors, score::INT AS score, CASE WHEN score >= 6 THEN 'selected' WHEN score <= -3 THEN 'rejected' ELSE 'review' END AS status, array_to_string({_REASONS}, '; ') AS reasons FROM s""")
def lexicon_triage(spark, d):
    """Triage of documents by a lexicon of words in the data; the first line stands for the authors."""
    docs = table(spark, d, "documents").withColumn("authors", values.count_authors(F.get(F.split("text", "\n"), F.lit(0))))
    return docs.select("doc_id", F.col("authors"), intake.triage(F.col("text"), F.col("authors"), _LEXICON).alias("t")).select("doc_id", "authors", "t.score", "t.status", F.array_join("t.reasons", "; ").alias("reasons"))


def _articles(spark, d):
    """documents as articles: source is the alert, the length's remainder the score, the label the processing."""
    docs = table(spark, d, "documents")
    score = (F.col("n_chars") % 23 - 5).cast("int")
    return docs.select(F.col("doc_id").alias("article_key"), F.col("source").alias("alert_name"), F.col("lang").alias("domain"), score.alias("score"), intake.status(score).alias("status"))


_ARTICLES = "SELECT doc_id AS article_key, source AS alert_name, lang AS domain, (n_chars % 23 - 5)::INT AS score, CASE WHEN n_chars % 23 - 5 >= 6 THEN 'selected' WHEN n_chars % 23 - 5 <= -3 THEN 'rejected' ELSE 'review' END AS status FROM documents"


@query(f"""
SELECT alert_name, count(*) AS article_count, count(*) FILTER (status = 'selected') AS selected_count, count(*) FILTER (status = 'review') AS review_count,
  count(*) FILTER (status = 'rejected') AS rejected_count, count(*) FILTER (status = 'invalid') AS invalid_count FROM ({_ARTICLES}) GROUP BY alert_name""")
def alert_summary(spark, d):
    """Counts by status of each alert."""
    return intake.alert_summary(_articles(spark, d))


@query(f"""
SELECT article_key, alert_name, score, quality FROM ({_ARTICLES}) a LEFT JOIN labels ON article_key = doc_id
WHERE status = 'selected' AND score >= 8 AND coalesce(quality, 1) NOT IN (0) ORDER BY score DESC, alert_name, article_key LIMIT 100""")
def backlog_topk(spark, d):
    """The best selected articles that their paper (labels) doesn't rule out: filters, left join, top k."""
    a = intake.conjunction(_articles(spark, d), F.col("status") == "selected", F.col("score") >= 8)
    j = a.join(table(spark, d, "labels").withColumnRenamed("doc_id", "article_key"), "article_key", "left").where(~F.coalesce("quality", F.lit(1)).isin(0))
    return j.orderBy(F.desc("score"), "alert_name", "article_key").limit(100).select("article_key", "alert_name", "score", "quality")


@query("""
WITH h AS (SELECT doc_id,
  CASE WHEN contains(lower(coalesce(text, '')), 'the of') THEN 3 ELSE contains(lower(coalesce(text, '')), 'the')::INT + contains(lower(coalesce(text, '')), 'of')::INT END AS t,
  CASE WHEN contains(lower(coalesce(lang, '')), 'the of') THEN 3 ELSE contains(lower(coalesce(lang, '')), 'the')::INT + contains(lower(coalesce(lang, '')), 'of')::INT END AS l FROM documents)
SELECT doc_id, (t + l)::INT AS hits, concat_ws(',', CASE WHEN t > 0 THEN 'text' END, CASE WHEN l > 0 THEN 'lang' END) AS fields FROM h WHERE t + l > 0""")
def topic_hits(spark, d):
    """Documents that hold a topic, whole or in part, and in which fields."""
    hits = intake.topic_hits("the of", {"text": F.col("text"), "lang": F.col("lang")})
    return table(spark, d, "documents").select("doc_id", hits.alias("h")).where("h.hits > 0").select("doc_id", "h.hits", F.array_join("h.fields", ",").alias("fields"))


@query(f"""
SELECT canonical_url, page_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY n_chars DESC, page_id) AS place FROM (SELECT page_id, {_CANONICAL} AS canonical_url, length(html) AS n_chars FROM pages)) WHERE place = 1""")
def keep_first_per_url(spark, d):
    """Of the pages of one canonical url the longest."""
    p = table(spark, d, "pages").select("page_id", ids.canonical_url("url").alias("canonical_url"), F.length("html").cast("long").alias("n_chars"))
    return intake.keep_first(p, F.col("canonical_url"), [F.desc("n_chars"), F.col("page_id")]).select("canonical_url", "page_id", "n_chars")


@query("""
SELECT o_orderkey AS article_key FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM lineitem l WHERE l.l_linenumber >= 7 AND (l.l_orderkey = o.o_orderkey OR l.l_partkey::VARCHAR = o.o_custkey::VARCHAR OR l.l_partkey::VARCHAR = CASE WHEN o.o_orderkey % 7 = 0 THEN (o.o_orderkey % 5000)::VARCHAR END))""")
def unqueued_anti(spark, d):
    """Anti join on any of three keys as hash joins: orders as articles, some line items as jobs."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("article_key"), F.col("o_custkey").cast("string").alias("article_url"), F.when(F.col("o_orderkey") % 7 == 0, (F.col("o_orderkey") % 5000).cast("string")).alias("scholar_url"))
    j = table(spark, d, "lineitem").where("l_linenumber >= 7").select(F.col("l_orderkey").alias("article_key"), F.col("l_partkey").cast("string").alias("source_url"))
    return intake.without_jobs(o, j).select("article_key")


@query(f"""
WITH p AS (SELECT sha256({_CANONICAL}) AS paper_key, {_CANONICAL} AS canonical_url, (900000 + page_id)::VARCHAR AS pmid, page_id FROM pages),
q AS (SELECT paper_key AS identifier FROM p UNION SELECT url FROM pages UNION SELECT pmid FROM p UNION SELECT 'unknown'),
m AS (SELECT identifier, 0 AS kind, paper_key FROM q JOIN p ON identifier = paper_key
  UNION ALL SELECT identifier, 1, paper_key FROM (SELECT identifier, {_CANONICAL.replace('url', 'identifier')} AS c FROM q) q JOIN p ON c = p.canonical_url
  UNION ALL SELECT identifier, 3, paper_key FROM q JOIN p ON identifier = pmid)
SELECT identifier, arg_min(paper_key, (kind, paper_key)) AS paper_key FROM m GROUP BY identifier""")
def multi_id_resolve(spark, d):
    """Every page's identifiers of several kinds to papers; kinds in order, blanks never match."""
    pages = table(spark, d, "pages")
    p = pages.select("page_id", F.sha2(ids.canonical_url("url").cast("binary"), 256).alias("paper_key"), ids.canonical_url("url").alias("canonical_url"), F.lit("").alias("doi"), (F.col("page_id") + 900000).cast("string").alias("pmid"))
    probes = p.select(F.col("paper_key").alias("identifier")).union(pages.select("url")).union(p.select("pmid")).union(spark.createDataFrame([("unknown",)], "u string")).distinct()
    return intake.resolve_papers(p, probes)


def _catalog_pages(spark, d):
    """documents as pages: the first line is the title, source and language the path and tags."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("doc_id").cast("string").alias("stem"), F.array("lang", "source").alias("tags"), F.lit(None).cast("string").alias("permalink"), F.col("text").alias("body"))


def _search_sql(units: list[str], q: str, mode: str) -> str:
    fields = {"title": "title", "tags": "tags", "path": "path", "body": "body"}
    n = len(units)
    count = lambda f: " + ".join(f"contains({f}, '{u}')::INT" for u in units)
    some = " AND ".join("(" + " OR ".join(f"contains({f}, '{u}')" for f in fields) + ")" for u in units) if mode != "any" else " OR ".join(f"contains({f}, '{u}')" for f in fields for u in units)
    score = " + ".join(f"{catalog.SEARCH[f]} * ({count(f)}) / {n}" for f in fields)
    bonus = f"CASE WHEN title = '{q}' THEN 30 WHEN path = '{q}' THEN 20 WHEN stem = '{q}' THEN 15" + (f" WHEN contains(title, '{q}') THEN 10" if mode == "phrase" else "") + " ELSE 0 END"
    found = "concat_ws(',', " + ", ".join(f"CASE WHEN {count(f)} > 0 THEN '{f}' END" for f in fields) + ")"
    return f"""
WITH k AS (SELECT lang || '/' || source || '/' || doc_id || '.md' AS p, {_key("string_split(text, chr(10))[1]")} AS title, {_key("lang || ' ' || source")} AS tags, {_key("lang || '/' || source || '/' || doc_id || '.md'")} AS path, {_key('text')} AS body, doc_id::VARCHAR AS stem FROM documents)
SELECT p AS path, round(least({score} + {bonus}, 100.0), 2) AS score, {found} AS matched_fields FROM k WHERE {some} ORDER BY score DESC, lower(p), p LIMIT 200"""


def _search(spark, d, q, mode):
    return catalog.search(_catalog_pages(spark, d), q, mode, limit=200).select("path", "score", F.array_join("matched_fields", ",").alias("matched_fields"))


@query(_search_sql(["the", "sch", "src7"], "the sch src7", "any"))
def field_search_any(spark, d):
    """The 200 pages that match any word of a query best."""
    return _search(spark, d, "the sch src7", "any")


@query(_search_sql(["the", "ou", "src7"], "the ou src7", "all"))
def field_search_all(spark, d):
    return _search(spark, d, "the ou src7", "all")


@query(_search_sql(["of the"], "of the", "phrase"))
def field_search_phrase(spark, d):
    return _search(spark, d, "of the", "phrase")


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""")
def passage_containment(spark, d):
    """Documents that hold a benchmark passage whole, by one rare word each instead of comparing each with each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    return catalog.containing(docs, items).select(F.col("id").alias("doc_id"), "item_id")


@query()
def near_verbatim(spark, d):
    """Documents and benchmark items of which any sentences are nearly the same (0.68 of the words or more), and the best similarity."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = verbatim.near(docs, table(spark, d, "benchmark").select("item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity")


_MARK = "regexp_replace(trim(text), '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g')"


@query(f"""
WITH s AS (SELECT doc_id, string_split({_MARK}, chr(1)) AS xs FROM documents), e AS (SELECT doc_id, unnest(xs) AS sentence, generate_subscripts(xs, 1) AS pos FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM e WHERE length(sentence) BETWEEN 60 AND 420 AND NOT contains(sentence, chr(10)))
SELECT doc_id, rank, sentence FROM f WHERE rank <= 4""")
def sentence_miner(spark, d):
    """The first four sentences of 60 to 420 characters on one line of each document."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence"))
    s = s.where((F.length("sentence").between(60, 420)) & ~F.contains("sentence", F.lit("\n")))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).cast("long")).where("rank <= 4").select("doc_id", "rank", "sentence")


_PACK = {"a": 300, "b": 900, "c": 400}


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
g AS (SELECT *, CASE pos % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS grp, CASE pos % 3 WHEN 0 THEN 300 WHEN 1 THEN 900 ELSE 400 END AS cap FROM l),
s AS (SELECT *, greatest(0, least(length(line), cap - coalesce(sum(length(line)) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM g),
t AS (SELECT *, greatest(0, least(n, 1400 - coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY grp, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept FROM s)
SELECT doc_id, pos::INT AS pos, grp, kept::BIGINT AS kept_chars, substr(line, 1, kept::BIGINT) AS text FROM t WHERE kept > 0""")
def context_packing(spark, d):
    """Lines of documents as sections of three groups, packed under budgets for each group and all."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.withColumn("group", F.element_at(F.array(*map(F.lit, "abc")), F.col("pos") % 3 + 1))
    return packets.pack(lines, "doc_id", _PACK, 1400).select("doc_id", "pos", F.col("group").alias("grp"), F.col("kept_chars").cast("long").alias("kept_chars"), "text")


@query("""
WITH w AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 86400 * (1 + event_id % 3) AS e FROM events),
r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(s) AS start_s, max(e) AS end_s FROM i GROUP BY user_id, island""")
def window_merge(spark, d):
    """Intervals after each event of a user, merged where they overlap or touch."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = table(spark, d, "events").select("user_id", s.alias("start"), (s + 86400 * (1 + F.col("event_id") % 3)).alias("end"))
    return packets.merge_windows(w, "user_id").select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query("""
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events, min(ts) AS created_at, max(ts) AS updated_at, count(*) FILTER (event_type = 'leased') AS attempt_count FROM events GROUP BY user_id""")
def job_state_fold(spark, d):
    """events as a job log: each job's last state."""
    return jobs.fold(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id").withColumnRenamed("user_id", "job_id")


_JOBS = """SELECT event_id AS job_id, event_type, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'retry' WHEN 'click' THEN 'scraping' WHEN 'view' THEN 'pr_open' ELSE 'needs_review' END AS state,
  (event_id % 4)::INT AS attempt_count, 3 AS max_attempts, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY * (event_id % 40) END AS due, user_id FROM events"""


def _jobs(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "retry").when(F.col("event_type") == "click", "scraping").when(F.col("event_type") == "view", "pr_open").otherwise("needs_review")
    due = F.when(F.col("event_id") % 3 != 0, F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 40).cast("int")))
    return e.select(F.col("event_id").alias("job_id"), state.alias("state"), (F.col("event_id") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), F.col("ts").alias("created_at"), due.alias("next_run_at"), due.alias("lease_expires_at"), "user_id")


@query(f"""
SELECT job_id, state, attempt_count, least(300 * pow(2, least(greatest(attempt_count - 1, 0), 30)), 21600)::BIGINT AS backoff FROM ({_JOBS})
WHERE attempt_count < max_attempts AND (state = 'queued' OR (state = 'retry' AND (due IS NULL OR due <= TIMESTAMP '2024-02-01')) OR (state = 'scraping' AND due <= TIMESTAMP '2024-02-01'))""")
def claim_eligible(spark, d):
    """events as jobs: which may be claimed at a given time, and how long the next wait would be."""
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return jobs.claimable(_jobs(spark, d), now).select("job_id", "state", "attempt_count", values.backoff_seconds("attempt_count").alias("backoff"))


@query(f"""SELECT user_id, count(*) FILTER (state NOT IN ('pr_open', 'duplicate', 'rejected', 'failed')) AS active FROM ({_JOBS}) GROUP BY user_id HAVING active > 1""")
def active_uniqueness(spark, d):
    """Keys with more than one active job."""
    return jobs.not_unique(_jobs(spark, d), "user_id")


_RANK = "list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type)"


@query(f"""
SELECT event_id, user_id, max({_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS rank,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events""")
def monotonic_state(spark, d):
    """Each event with the state before it and the highest rank of a state so far."""
    rank = F.array_position(F.array(*map(F.lit, ("signup", "view", "click", "purchase", "error"))), F.col("event_type"))
    out = jobs.running_state(jobs.transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id"), rank, "user_id", "ts", "event_id")
    return out.select("event_id", "user_id", "rank", "from_state")


@query(f"""
WITH p AS (SELECT page_id, {_CANONICAL} AS paper_key, {_TITLE} AS title, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'doi' || page_id END AS doi FROM pages),
o AS (SELECT paper_key, arg_max(title, page_id) AS title, arg_max(doi, page_id) AS doi, max(page_id) AS updated_at FROM p WHERE page_id % 3 < 2 GROUP BY 1),
n AS (SELECT paper_key, arg_max(CASE WHEN page_id % 2 = 0 THEN title ELSE '' END, page_id) AS title, arg_max(doi, page_id) AS doi, max(page_id) AS updated_at FROM p WHERE page_id % 3 > 0 GROUP BY 1)
SELECT coalesce(o.paper_key, n.paper_key) AS paper_key,
  CASE WHEN o.paper_key IS NOT NULL AND n.paper_key IS NOT NULL THEN coalesce(nullif(n.title, ''), o.title) WHEN o.paper_key IS NOT NULL THEN o.title ELSE n.title END AS title,
  CASE WHEN o.paper_key IS NOT NULL AND n.paper_key IS NOT NULL THEN coalesce(nullif(n.doi, ''), o.doi) WHEN o.paper_key IS NOT NULL THEN o.doi ELSE n.doi END AS doi,
  coalesce(n.updated_at, o.updated_at) AS updated_at FROM o FULL JOIN n ON o.paper_key = n.paper_key""")
def upsert_papers(spark, d):
    """Two overlapping sets of pages merged as papers: what is not blank wins."""
    p = table(spark, d, "pages").select("page_id", ids.canonical_url("url").alias("paper_key"), _title().alias("title"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("doi"), F.col("page_id").cast("string"))).alias("doi"), F.col("page_id").alias("updated_at"))
    old = papers.last_change(p.where("page_id % 3 < 2"), "paper_key", "page_id").drop("page_id")
    new = papers.last_change(p.where("page_id % 3 > 0").withColumn("title", F.when(F.col("page_id") % 2 == 0, F.col("title")).otherwise("")), "paper_key", "page_id").drop("page_id")
    return papers.upsert_papers(old, new)


@query("""
WITH l AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS log FROM conversations GROUP BY conv_id), o AS (SELECT *, (conv_id * 37) % 900 AS off FROM l)
SELECT conv_id, CASE WHEN off > length(log) THEN log ELSE substr(log, off + 1) END AS chunk, length(log) AS next_offset, off > length(log) AS reset FROM o""")
def log_tail(spark, d):
    """Conversations as logs: what follows an offset; from the start if it lies past the end."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return papers.turns_tail(turns, "conv_id", "turn", "text", (F.col("conv_id") * 37 % 900).cast("long"))


@query("""
WITH w AS (SELECT conv_id, turn, generate_subscripts(string_split(trim(text), ' '), 1) AS pos, lower(unnest(string_split(trim(text), ' '))) AS word FROM conversations),
f AS (SELECT conv_id, word, min((turn, pos)) AS place FROM w WHERE word <> '' AND NOT contains(word, chr(10)) GROUP BY ALL)
SELECT conv_id, array_to_string(list(word ORDER BY place)[1:20], ' ') AS words FROM f GROUP BY conv_id""")
def dedupe_first_seen(spark, d):
    """The first twenty different words of a conversation, in order."""
    # a turn's first twenty different words are all that it can add, so no more leave its row
    own = F.array_distinct(F.filter(F.split(F.lower(F.trim("text")), " "), lambda w: (w != "") & ~F.contains(w, F.lit("\n"))))
    words = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.slice(own, 1, 20)).alias("pos", "word"))
    seen = words.groupBy("conv_id", "word").agg(F.min(F.struct("turn", "pos")).alias("place"))
    # twenty of each conversation are left before the exchange, however long it is
    first = seen.withColumn("rank", F.row_number().over(W.partitionBy("conv_id").orderBy("place"))).where("rank <= 20")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(ranked, lambda x: x["word"]), " ").alias("words"))


@query(f"""SELECT doc_id, md5({_key('text')}) AS key_md5, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_md5, replace({_key("string_split(text, chr(10))[1]")}, ' ', '-') AS slug,
  ends_with(trim(regexp_replace(text, '\\s+', ' ', 'g')), '...') OR ends_with(trim(regexp_replace(text, '\\s+', ' ', 'g')), '…') AS truncated, len(list_distinct(list_filter(string_split({_key('text')}, ' '), lambda w: w <> ''))) AS distinct_words FROM documents""")
def text_normalizers(spark, d):
    """Normal forms of whole texts."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.md5(text.key("text").cast("binary")).alias("key_md5"), F.md5(text.collapse("text").cast("binary")).alias("collapsed_md5"), text.slug(line).alias("slug"), text.is_truncated("text").alias("truncated"), F.size(F.array_distinct(text.words(text.key("text")))).cast("long").alias("distinct_words"))


_TAGGED = "SELECT doc_id::VARCHAR AS path, unnest([lang, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN upper(source) ELSE source || '!' END]) AS tag FROM documents"


@query(f"""
WITH u AS ({_TAGGED}), k AS (SELECT *, {_key('tag')} AS normalized FROM u), t AS (SELECT normalized, tag, count(*) AS n FROM k GROUP BY ALL),
p AS (SELECT normalized, array_to_string(list_sort(list_distinct(list(path)))[1:5], ',') AS example_paths FROM k GROUP BY 1)
SELECT normalized, sum(n)::BIGINT AS total, first(tag ORDER BY n DESC, lower(tag), tag) AS suggested_canonical, string_agg(tag || ':' || n, ',' ORDER BY n DESC, lower(tag), tag) AS variants, any_value(example_paths) AS example_paths
FROM t JOIN p USING (normalized) GROUP BY normalized HAVING count(*) >= 2""")
def tag_audit(spark, d):
    """Tags (sources in three spellings) that are one tag."""
    docs = table(spark, d, "documents")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.upper("source")).otherwise(F.concat("source", F.lit("!")))
    pages = docs.select(F.col("doc_id").cast("string").alias("path"), F.array("lang", spelled).alias("tags"))
    variants = F.array_join(F.transform("variants", lambda v: F.concat(v["tag"], F.lit(":"), v["count"].cast("string"))), ",")
    return catalog.audit_tags(pages).select("normalized", "total", "suggested_canonical", variants.alias("variants"), F.array_join("example_paths", ",").alias("example_paths"))


@query(f"""
WITH c AS (SELECT tag, count(*) AS n, {_key('tag')} AS t FROM ({_TAGGED}) GROUP BY ALL),
s AS (SELECT *, CASE WHEN t = 'src1 en' THEN 100.0 WHEN contains(t, 'src1 en') THEN 80.0 WHEN contains('src1 en', t) THEN 70.0 WHEN contains(t, 'src1') OR contains(t, 'en') THEN 50.0 * (contains(t, 'src1')::INT + contains(t, 'en')::INT) / 2 ELSE 0.0 END AS score FROM c)
SELECT tag, n AS count, round(score, 2)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, n DESC, lower(tag), tag LIMIT 20""")
def tag_suggest(spark, d):
    """Tags that fit a query, by kind of match and frequency."""
    docs = table(spark, d, "documents")
    spelled = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.upper("source")).otherwise(F.concat("source", F.lit("!")))
    return catalog.suggest_tags(catalog.tag_counts(docs.select(F.array("lang", spelled).alias("tags"))), "src1 en")


@query(f"""
WITH p AS (SELECT lang || '/' || source || '/' || doc_id || '.md' AS path, regexp_replace(array_to_string(string_split({_key("string_split(text, chr(10))[1]")}, ' ')[1:2], ' '), '^(?:the|what is|what are|an introduction to)\\s+', '') AS alias FROM documents),
a AS (SELECT * FROM p WHERE length(alias) >= 4), i AS (SELECT item_id, ' ' || {_key('text')} || ' ' AS t FROM benchmark)
SELECT item_id AS packet_id, path, alias AS entity FROM i JOIN a ON contains(t, ' ' || alias || ' ')""")
def phrase_eligible(spark, d):
    """Pages (documents by the first two words) that a packet (benchmark item) names, joined by word n-grams."""
    first = F.array_join(F.slice(F.split(text.key(F.get(F.split("text", "\n"), F.lit(0))), " "), 1, 2), " ")
    pages = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), first.alias("title"), first.alias("stem"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("packet_id"), F.col("text").alias("abstract"), *[F.lit("").alias(f) for f in catalog.RETRIEVAL if f != "abstract"])
    return catalog.eligible(pages, items).select("packet_id", "path", F.explode("entity_matches").alias("entity"))


@query(f"""
SELECT host, arg_max(page_id, (score, page_id)) AS page_id, max(score) AS score FROM (SELECT page_id, {_HOST} AS host, (length(html) % 50)::BIGINT AS score FROM pages) GROUP BY host""")
def best_attempt(spark, d):
    """Of the pages of a host (as attempts) the best one, the later of equals."""
    p = table(spark, d, "pages").select("page_id", ids.host("url").alias("host"), (F.length("html") % 50).cast("long").alias("score"))
    return packets.best_attempt(p, "host", F.col("score"), "page_id").select("host", "page_id", "score")


@query("""
SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, count(*) AS turns, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY conv_id""")
def latest_related(spark, d):
    """The last row's attributes of each conversation, with counts."""
    c = table(spark, d, "conversations")
    last = intake.latest(c, "conv_id", F.col("turn"), "role", "turn")
    return last.join(c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users")), "conv_id")


@query(f"""
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({_key('text')}, ' '), lambda w: w <> '')) AS ws, {_key('text')} AS k FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0.0 WHEN a.k = b.k THEN 1.0 ELSE round(len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), len(b.ws)), 6) END AS overlap
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_overlap(spark, d):
    """Share of words that a turn has in common with the next one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.overlap_ratio("text", "next"), 6).alias("overlap"))


@query("""
WITH f AS (SELECT p_partkey, p_name, p_brand, p_size, count(*) OVER () AS total FROM part WHERE (p_name ILIKE '%1%' OR p_brand ILIKE '%brand#3%' OR p_type ILIKE '%steel%') AND p_size >= 10)
SELECT p_partkey, p_name, p_brand, p_size, total FROM f ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 50""")
def filtered_page(spark, d):
    """The second page of a filtered, ordered list, with the number of all rows."""
    p = intake.conjunction(table(spark, d, "part"), intake.matches_any(["p_name"], "1") | intake.matches_any(["p_brand"], "brand#3") | intake.matches_any(["p_type"], "steel"), F.col("p_size") >= 10, None)
    return intake.page_of(p.select("p_partkey", "p_name", "p_brand", "p_size"), [F.desc("p_size"), F.col("p_partkey")], 50, 50)


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE 'n.d.' END AS day, least(250, greatest(10, coalesce(try_cast(substr(o_orderpriority, 1, 1) AS INT), 50) * 60)) AS size
FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01'""")
def date_window(spark, d):
    """Orders in a window of days, with partial dates made whole and a clamped number."""
    o = table(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-M")).otherwise("n.d.")
    size = F.least(F.lit(250), F.greatest(F.lit(10), values.parse_int(F.substring("o_orderpriority", 1, 1), 50) * 60))
    o = o.where(values.in_window(F.col("o_orderdate"), F.lit("1996-06-01").cast("date"), after="1996-03-01", before="1996-06-01"))
    return o.select("o_orderkey", values.partial_date(raw).alias("day"), size.alias("size"))


@query("""
WITH a AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT n_name, count(*) AS customers, count(*) FILTER (s.suppliers IS NULL) AS without_supplier, max(c_acctbal) AS best FROM a JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 3000 GROUP BY 1) s ON s_nationkey = n_nationkey GROUP BY n_name""")
def nation_accounts(spark, d):
    """Inner and left join of dimensions, conditional counts."""
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_nationkey", "c_acctbal")
    s = table(spark, d, "supplier").where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    n = table(spark, d, "nation").join(s, "n_nationkey", "left")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(F.col("suppliers").isNull()).alias("without_supplier"), F.max("c_acctbal").alias("best"))


@query()
def page_packets(spark, d):
    """Pages as packets: title, body, study type and retrieval issues, and whether they pass the gate's rules on issues."""
    p = readers.html_packets(table(spark, d, "pages").select("url", "html"))
    return p.select("url", "title", F.length("body_markdown").alias("body_chars"), "study_type", F.array_join("retrieval_issues", ",").alias("issues"), classify.content_score(F.col("body_markdown")).alias("score"))
