"""Queries of the operators on articles, papers, jobs, pages, packets and plans, over the driver's tables, and their SQL.

documents stand for articles, papers and pages, events for jobs; what the rules need besides is picked from short lists
by a row's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import classify, ids, text, values
from .operators import catalog, intake, jobs, packets, papers
from .plans import editing, validate
from .queries import _key, query, table
from .queries_rules import _HEADINGS, _LINE, _doc, collapsed, joined, matches, pick, pick_sql, quoted



def _now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


_NOW_SQL = "TIMESTAMP '2024-02-01'"
_ARTICLES = f"""SELECT doc_id::VARCHAR AS article_key, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'p' || (doc_id // 5) END AS paper_key, source AS alert_name, 'Title ' || doc_id AS title,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'http://www.' || lang || '.org/' || (doc_id % 300) END AS article_url, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'http://s.org/' || doc_id END AS scholar_url,
  (n_chars % 23 - 5)::INT AS score, {pick_sql(('selected', 'review', 'selected', 'rejected', 'invalid'), 'doc_id')} AS status, CASE WHEN doc_id % 8 = 0 THEN TIMESTAMP '2024-01-01' END AS processed_at,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (doc_id % 977) AS created_at, TIMESTAMP '2024-01-02' AS updated_at, doc_id % 3 = 0 AS is_open_access, (doc_id % 7)::INT AS rank_in_email, lang AS domain FROM documents"""


def _articles(spark, d):
    n = _doc().cast("string")
    day = lambda x: F.lit(f"2024-01-0{x} 00:00:00").cast("timestamp_ntz")
    paper = F.when(_doc() % 9 != 0, F.concat(F.lit("p"), F.expr("doc_id div 5").cast("string")))
    url = F.when(_doc() % 6 == 0, "").otherwise(F.concat(F.lit("http://www."), "lang", F.lit(".org/"), (_doc() % 300).cast("string")))
    return table(spark, d, "documents").select(
        n.alias("article_key"), paper.alias("paper_key"), F.col("source").alias("alert_name"), F.concat(F.lit("Title "), n).alias("title"), url.alias("article_url"), F.when(_doc() % 4 != 0, F.concat(F.lit("http://s.org/"), n)).alias("scholar_url"),
        (F.col("n_chars") % 23 - 5).cast("int").alias("score"), pick(("selected", "review", "selected", "rejected", "invalid"), _doc()).alias("status"), F.when(_doc() % 8 == 0, day(1)).alias("processed_at"),
        (day(1) + F.make_dt_interval(mins=(_doc() % 977).cast("int"))).alias("created_at"), day(2).alias("updated_at"), (_doc() % 3 == 0).alias("is_open_access"), (_doc() % 7).cast("int").alias("rank_in_email"), F.col("lang").alias("domain"),
    )


_PAPERS = f"""SELECT 'p' || doc_id AS paper_key, source || ' ' || lang || ' ' || n_chars AS title, 'https://x.org/' || doc_id AS canonical_url, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 5 = 0 THEN '' ELSE (70000 + doc_id)::VARCHAR END AS pmid,
  {pick_sql((*values.WORKFLOW, None), 'n_chars')} AS workflow_state, CASE WHEN n_chars % 3 = 0 THEN 'a/' || doc_id ELSE '' END AS matched_content_path, CASE WHEN n_chars % 4 = 0 THEN 'z' END AS archived_source_path,
  TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (n_chars % 5) AS updated_at, CASE WHEN n_chars % 2 = 0 THEN TIMESTAMP '2023-01-01' END AS scraped_at, CAST(NULL AS TIMESTAMP) AS pr_opened_at FROM documents"""


def _papers(spark, d):
    n = _doc().cast("string")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, d, "documents").select(
        F.concat(F.lit("p"), n).alias("paper_key"), F.concat_ws(" ", "source", "lang", F.col("n_chars").cast("string")).alias("title"), F.concat(F.lit("https://x.org/"), n).alias("canonical_url"), F.concat(F.lit("10.1/"), n).alias("doi"), F.when(_doc() % 5 == 0, "").otherwise((_doc() + 70000).cast("string")).alias("pmid"),
        pick((*values.WORKFLOW, None), F.col("n_chars")).alias("workflow_state"), F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("a/"), n)).otherwise("").alias("matched_content_path"), F.when(F.col("n_chars") % 4 == 0, "z").alias("archived_source_path"),
        (at("2024-01-01 00:00:00") + F.make_dt_interval(days=(F.col("n_chars") % 5).cast("int"))).alias("updated_at"), F.when(F.col("n_chars") % 2 == 0, at("2023-01-01 00:00:00")).alias("scraped_at"), at(None).alias("pr_opened_at"),
    )


_STATES = ("queued", "retry", "failed", "leased", "rejected", "pr_open", "validated", "needs_review", "scraping")
_JOBS = f"""SELECT event_id AS job_id, (event_id // 2 * 7)::VARCHAR AS article_key, 'http://s.org/' || (event_id // 3 * 11) AS source_url, CAST(NULL AS VARCHAR) AS canonical_source_url, {pick_sql(_STATES, 'event_id + coalesce(length(event_type), 0)')} AS state, (event_id % 4)::INT AS attempt_count, 3 AS max_attempts,
  {pick_sql(('w1', None, 'w2'), 'coalesce(user_id, 0)')} AS lease_owner, ts AS lease_expires_at, ts AS next_run_at, ts AS updated_at, CASE WHEN event_id % 2 = 0 THEN ts END AS finished_at, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id ELSE '' END AS run_id, CASE WHEN event_id % 5 = 0 THEN 'http://pr/' || event_id END AS pr_url, event_type AS error FROM events"""


def _jobs(spark, d):
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    return table(spark, d, "events").select(
        e.alias("job_id"), F.expr("event_id div 2 * 7").cast("string").alias("article_key"), F.concat(F.lit("http://s.org/"), F.expr("event_id div 3 * 11").cast("string")).alias("source_url"), F.lit(None).cast("string").alias("canonical_source_url"), pick(_STATES, e + F.coalesce(F.length("event_type"), F.lit(0))).alias("state"), (e % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"),
        pick(("w1", None, "w2"), F.coalesce("user_id", F.lit(0))).alias("lease_owner"), F.col("ts").alias("lease_expires_at"), F.col("ts").alias("next_run_at"), F.col("ts").alias("updated_at"), F.when(e % 2 == 0, F.col("ts")).alias("finished_at"), F.when(e % 3 == 0, F.concat(F.lit("r"), n)).otherwise("").alias("run_id"), F.when(e % 5 == 0, F.concat(F.lit("http://pr/"), n)).alias("pr_url"), F.col("event_type").alias("error"),
    )


_CANON = "'https://' || regexp_replace(regexp_extract({0}, '^https?://([^/]*)', 1), '^www\\.', '') || regexp_replace(regexp_extract({0}, '^https?://[^/]*([^?#]*)', 1), '/+$', '')"
_SOURCE = "trim(coalesce(nullif(article_url, ''), nullif(scholar_url, ''), ''))"


@query(f"""
SELECT article_key, score, workflow_state FROM ({_ARTICLES}) a LEFT JOIN (SELECT paper_key, workflow_state FROM ({_PAPERS})) p USING (paper_key)
WHERE score >= -3 AND processed_at IS NULL ORDER BY score DESC, alert_name NULLS FIRST, rank_in_email NULLS FIRST, article_key LIMIT 300""")
def article_list(spark, d):
    """The articles that a list shows: a negative bound, the unprocessed ones, with their papers."""
    return intake.list_articles(_articles(spark, d), _papers(spark, d), min_score=-3, processed=False, limit=300).select("article_key", "score", "workflow_state")


@query(f"""
SELECT article_key, score, doi FROM ({_ARTICLES}) a LEFT JOIN (SELECT paper_key, doi, workflow_state FROM ({_PAPERS})) p USING (paper_key)
WHERE status = 'selected' AND score >= 2 AND is_open_access AND (article_url = '' OR contains(regexp_extract(article_url, '^https?://([^/]*)', 1), 'en')) AND processed_at IS NULL
  AND coalesce(workflow_state, 'discovered') NOT IN ('drafted', 'committed', 'pr_open', 'merged') ORDER BY score DESC, alert_name NULLS FIRST, created_at DESC, article_key LIMIT 200""")
def article_backlog(spark, d):
    """The open backlog of one source, best first."""
    return intake.backlog(_articles(spark, d), _papers(spark, d), min_score=2, source="EN", limit=200).select("article_key", "score", "doi")


@query(f"""SELECT paper_key, updated_at FROM ({_PAPERS}) WHERE coalesce(matched_content_path, '') <> '' AND workflow_state = 'matched' ORDER BY updated_at DESC, title, paper_key LIMIT 40""")
def paper_list(spark, d):
    return intake.list_papers(_papers(spark, d), "matched", "matched", 40).select("paper_key", "updated_at")


@query(f"""
WITH p AS (SELECT DISTINCT x AS identifier FROM (SELECT unnest([article_key, article_url, scholar_url]) AS x FROM ({_ARTICLES})) WHERE x <> ''), a AS ({_ARTICLES}),
m AS (SELECT identifier, 0 AS kind, article_key FROM p JOIN a ON identifier = article_key UNION ALL SELECT identifier, 1, article_key FROM p JOIN a ON identifier = article_url OR identifier = scholar_url)
SELECT identifier, arg_min(article_key, (kind, article_key)) AS article_key FROM m GROUP BY identifier""")
def article_lookup(spark, d):
    """The article of every identifier: its key before a url."""
    a = _articles(spark, d)
    probes = a.select(F.explode(F.array("article_key", "article_url", "scholar_url")).alias("identifier")).where("identifier <> ''").distinct()
    return intake.find_articles(a, probes).select("identifier", "article_key")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN '' END AS reasons FROM documents")
def stored_reasons(spark, d):
    """Reasons of scores, kept as JSON, as lists."""
    n = F.when(_doc() % 3 == 0, F.to_json(F.array("lang", "source"))).when(_doc() % 3 == 1, "[]").otherwise("{no list")
    t = table(spark, d, "documents").select("doc_id", n.alias("reasons_json"))
    return intake.with_reasons(t).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


_DOMAINS = ("en", " ", "..", "a/b", "a\\b", "Natural Healing", None)
_FAULTS = [("missing_key", "trim(coalesce(article_key, '')) = ''"), ("unknown_status", "coalesce(status, '') NOT IN ('selected', 'review', 'rejected', 'invalid')"), ("invalid_domain", "trim(coalesce(domain, '')) IN ('', '.', '..') OR contains(domain, '/') OR contains(domain, '\\')"), ("no_source", "coalesce(article_url, '') = '' AND coalesce(scholar_url, '') = ''")]


@query(f"""
WITH f AS (SELECT doc_id, CASE WHEN n_chars % 10 = 0 THEN ' ' ELSE doc_id::VARCHAR END AS article_key, {pick_sql(('selected', 'x', None), 'n_chars')} AS status, CASE WHEN n_chars % 3 = 0 THEN lang ELSE {pick_sql(_DOMAINS, 'n_chars')} END AS domain, CASE WHEN n_chars % 6 = 0 THEN '' ELSE source END AS article_url, CASE WHEN n_chars % 4 = 0 THEN NULL ELSE 's' END AS scholar_url FROM documents)
SELECT doc_id, {joined(_FAULTS)} AS faults FROM f""")
def article_faults(spark, d):
    """What would be refused of articles, row by row."""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 10 == 0, " ").otherwise(_doc().cast("string")).alias("article_key"), pick(("selected", "x", None), F.col("n_chars")).alias("status"), F.when(F.col("n_chars") % 3 == 0, F.col("lang")).otherwise(pick(_DOMAINS, F.col("n_chars"))).alias("domain"), F.when(F.col("n_chars") % 6 == 0, "").otherwise(F.col("source")).alias("article_url"), F.when(F.col("n_chars") % 4 != 0, "s").alias("scholar_url"))
    return intake.with_faults(t).select("doc_id", F.array_join("faults", ",").alias("faults"))


@query(f"""
WITH a AS ({_ARTICLES}), p AS ({_PAPERS}), q AS (SELECT 'https://x.org/' || doc_id || '/' AS identifier FROM documents UNION SELECT (70000 + doc_id)::VARCHAR FROM documents UNION SELECT scholar_url FROM a WHERE scholar_url IS NOT NULL),
m AS (SELECT identifier, paper_key FROM q JOIN p ON identifier = canonical_url || '/' OR (identifier = pmid) UNION SELECT identifier, a.paper_key FROM q JOIN a ON identifier = scholar_url JOIN p ON a.paper_key = p.paper_key)
SELECT identifier, min(paper_key) AS paper_key FROM m GROUP BY identifier""")
def resolve_via_articles(spark, d):
    """Identifiers to papers, by the papers themselves or else by urls of their articles."""
    a, docs = _articles(spark, d), table(spark, d, "documents")
    probes = docs.select(F.concat(F.lit("https://x.org/"), _doc().cast("string"), F.lit("/")).alias("identifier")).union(docs.select((_doc() + 70000).cast("string"))).union(a.where("scholar_url is not null").select("scholar_url")).distinct()
    return intake.resolve_with_articles(_papers(spark, d), a, probes)


@query(f"SELECT job_id, title, score, a.status AS article_status, state FROM ({_JOBS}) j JOIN ({_ARTICLES}) a USING (article_key)")
def job_articles(spark, d):
    """Jobs with their articles."""
    return jobs.with_articles(_jobs(spark, d), _articles(spark, d)).select("job_id", "title", "score", "article_status", "state")


_RANK = "greatest(coalesce(list_position([" + ", ".join(quoted(x) for x in values.WORKFLOW) + "], {}), 1), 1)"
_ADVANCED = f"""
WITH p AS ({_PAPERS}), c AS ({{}}), j AS (SELECT p.*, c.state, c.path AS new_path, c.commit, c.pr, c.paper_key IS NOT NULL AS hit FROM p LEFT JOIN c USING (paper_key)),
t AS (SELECT *, CASE WHEN pr IS NOT NULL AND {_RANK.format("coalesce(state, 'discovered')")} < 6 THEN 'pr_open' WHEN commit IS NOT NULL AND {_RANK.format("coalesce(state, 'discovered')")} < 5 THEN 'committed' WHEN coalesce(new_path, '') <> '' AND {_RANK.format("coalesce(state, 'discovered')")} < 3 THEN 'matched' ELSE coalesce(state, 'discovered') END AS target FROM j),
r AS (SELECT *, greatest({_RANK.format('target')}, {_RANK.format('workflow_state')}) AS rank, state IS NOT NULL OR coalesce(new_path, '') <> '' OR commit IS NOT NULL OR pr IS NOT NULL AS changed FROM t)
SELECT paper_key, CASE WHEN changed THEN [{', '.join(quoted(x) for x in values.WORKFLOW)}][rank] ELSE workflow_state END AS workflow_state, coalesce(nullif(new_path, ''), matched_content_path) AS matched_content_path,
  CASE WHEN changed THEN {_NOW_SQL} ELSE updated_at END AS updated_at, coalesce(scraped_at, CASE WHEN changed AND rank >= 2 THEN {_NOW_SQL} END) AS scraped_at, CASE WHEN changed AND rank >= 6 THEN {_NOW_SQL} END AS pr_opened_at FROM r"""


@query(_ADVANCED.format(f"SELECT 'p' || doc_id AS paper_key, {pick_sql((None, 'drafted', 'scraped'), 'doc_id')} AS state, CASE WHEN doc_id % 4 = 1 THEN 'n/' || doc_id ELSE '' END AS path, CASE WHEN doc_id % 5 = 0 THEN 'c' END AS commit, CASE WHEN doc_id % 11 = 0 THEN 'r' END AS pr FROM documents WHERE n_chars % 3 > 0"))
def paper_progress(spark, d):
    """Papers after changes of state: states only rise, evidence raises them, times are set once."""
    n = _doc().cast("string")
    changes = table(spark, d, "documents").where("n_chars % 3 > 0").select(F.concat(F.lit("p"), n).alias("paper_key"), pick((None, "drafted", "scraped"), _doc()).alias("state"), F.when(_doc() % 4 == 1, F.concat(F.lit("n/"), n)).otherwise("").alias("matched_content_path"), F.when(_doc() % 5 == 0, "c").alias("commit"), F.when(_doc() % 11 == 0, "r").alias("pr"), F.lit(None).cast("string").alias("archive_path"))
    return papers.advance(_papers(spark, d), changes, _now()).select("paper_key", "workflow_state", "matched_content_path", "updated_at", "scraped_at", "pr_opened_at")


@query(_ADVANCED.format("SELECT paper_key, 'committed' AS state, max(path) AS path, NULL AS commit, NULL AS pr FROM (SELECT source || '/' || (n_chars // 9) AS path, arg_max('p' || (doc_id // 5), doc_id) AS paper_key FROM documents GROUP BY 1) GROUP BY paper_key"))
def path_progress(spark, d):
    """Papers raised to a state by the paths that stand for them; the last record of a path counts."""
    records = table(spark, d, "documents").select(F.concat_ws("/", "source", F.expr("n_chars div 9").cast("string")).alias("path"), F.concat(F.lit("p"), F.expr("doc_id div 5").cast("string")).alias("paper_key"), _doc().alias("n"))
    return papers.advance_paths(_papers(spark, d), records, "committed", _now()).select("paper_key", "workflow_state", "matched_content_path", "updated_at", "scraped_at", "pr_opened_at")


_REFS = "SELECT lang || '/' || doc_id AS path, 1 AS ref_num, 'First ' || source AS title, 'http://www.' || source || '.org/' || doc_id || '/x' AS url FROM documents UNION ALL SELECT lang || '/' || doc_id, 2, 'Second', 'https://B.org/' || (doc_id % 40) FROM documents"


def _referring(spark, d):
    n = _doc().cast("string")
    body = F.concat(F.lit("[^1]: [First "), "source", F.lit("](http://www."), "source", F.lit(".org/"), n, F.lit("/x)\n[^2]: [Second](https://B.org/"), (_doc() % 40).cast("string"), F.lit(")"))
    return table(spark, d, "documents").select(F.concat_ws("/", "lang", n).alias("path"), body.alias("body"))


_PROBES = ("https://b.org/7", ".ORG/12", "src3.org/23", "Second", "first SRC1", "b.or", "/x", "https://www.src2.org/22/x/", "nothing at all", "")
_HITS = f"""WITH r AS ({_REFS}), q AS (SELECT unnest([{', '.join(quoted(x) for x in _PROBES)}]) AS identifier), k AS (SELECT identifier, lower(trim(identifier)) AS low, CASE WHEN regexp_matches(identifier, '^https?://') THEN {_CANON.format('identifier')} ELSE lower(identifier) END AS c, {_key('identifier')} AS t FROM q)
SELECT DISTINCT identifier, path, ref_num, url AS ref_url FROM k JOIN r ON (low <> '' AND contains(lower(url), low)) OR (c <> '' AND lower(c) = lower({_CANON.format('url')})) OR (t <> '' AND t = {_key('title')})"""


@query(_HITS)
def duplicate_references(spark, d):
    """References that hold an identifier anywhere in their url, or have its canonical url or title."""
    probes = spark.createDataFrame([(x,) for x in _PROBES], "identifier string")
    return catalog.duplicate_papers(_referring(spark, d), probes)


@query(f"""
WITH h AS ({_HITS}), c AS (SELECT identifier[1:1] AS check_id, path, ref_num, ref_url FROM h), g AS (SELECT check_id, count(*) AS n FROM (SELECT DISTINCT * FROM c) GROUP BY check_id),
p AS (SELECT substr(source, 4, 1) AS check_id, doc_id AS n, 'p' || doc_id AS paper_key, {pick_sql((*values.WORKFLOW, None), 'doc_id')} AS workflow_state FROM documents),
b AS (SELECT check_id, arg_min(paper_key, (coalesce(workflow_state, '') NOT IN ('drafted', 'committed', 'pr_open', 'merged'), n)) AS paper_key FROM p GROUP BY check_id)
SELECT coalesce(g.check_id, b.check_id) AS check_id, coalesce(n, 0)::INT AS content_hit_count, paper_key FROM g FULL JOIN b ON g.check_id = b.check_id""")
def merged_checks(spark, d):
    """Several checks of a subject as one: distinct hits, and a paper under way before others."""
    hits = duplicate_references(spark, d).select(F.substring("identifier", 1, 1).alias("check_id"), "path", "ref_num", "ref_url")
    found = table(spark, d, "documents").select(F.substring("source", 4, 1).alias("check_id"), _doc().alias("n"), F.concat(F.lit("p"), _doc().cast("string")).alias("paper_key"), pick((*values.WORKFLOW, None), _doc()).alias("workflow_state"))
    return catalog.merge_duplicate_checks(hits, found).select("check_id", "content_hit_count", "paper_key")


@query(f"""
WITH q AS (SELECT 'HTTPS://b.ORG/' || i AS url FROM range(45) t(i) UNION ALL SELECT 'http://src1.org/' || i || '/x/' FROM range(60) t(i)), r AS ({_REFS})
SELECT q.url, min((path, ref_num)).path AS path, min((path, ref_num)).ref_num AS ref_num FROM (SELECT q.url, struct_pack(path := path, ref_num := ref_num) AS s, path, ref_num FROM q JOIN r ON replace(regexp_replace(regexp_replace(lower(q.url), '^https?://', ''), '/+$', ''), 'www.', '') = replace(regexp_replace(regexp_replace(lower(r.url), '^https?://', ''), '/+$', ''), 'www.', '')) q GROUP BY q.url""".replace("min((path, ref_num)).path", "min(s).path").replace("min((path, ref_num)).ref_num", "min(s).ref_num"))
def cited_urls(spark, d):
    """The first page that cites each url, whatever its protocol, case and last slash."""
    urls = spark.range(45).select(F.concat(F.lit("HTTPS://b.ORG/"), F.col("id").cast("string")).alias("url")).union(spark.range(60).select(F.concat(F.lit("http://src1.org/"), F.col("id").cast("string"), F.lit("/x/"))))
    return catalog.cited_in(_referring(spark, d), urls)


@query(f"""
WITH t AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS ws FROM (SELECT doc_id AS id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t, [lang] AS have FROM documents)), k AS (SELECT lang AS tag, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT w, 7 FROM (SELECT unnest(['the of', 'and', 'le la', 'und der']) AS w)),
h AS (SELECT id, tag, n FROM t JOIN k ON contains(t, tag) AND list_contains(ws, regexp_extract(tag, '[a-z0-9]+', 0)) AND NOT list_contains(have, tag)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, tag) AS rank FROM h) SELECT id, tag, rank::INT AS rank FROM r WHERE rank <= 3""")
def tags_in_text(spark, d):
    """Known tags that texts name and don't have."""
    docs = table(spark, d, "documents")
    counts = docs.groupBy(F.col("lang").alias("tag")).agg(F.count("*").alias("n")).union(spark.createDataFrame([(x, 7) for x in ("the of", "and", "le la", "und der")], "tag string, n long"))
    return catalog.tags_in(docs.select(_doc().alias("id"), "text", F.array("lang").alias("tags")), counts, 3).select("id", "tag", "rank")


@query(f"""
SELECT alert_name, count(*) AS articles, count(*) FILTER (status = 'selected') AS selected, count(*) FILTER (status = 'review') AS review, (SELECT count(*) FROM conversations WHERE coalesce(text, '') <> '' AND turn % 2 = 0) AS messages_with_html FROM ({_ARTICLES}) GROUP BY alert_name""")
def sync_summary(spark, d):
    """Articles of each alert, with the number of messages that had a text."""
    messages = table(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("html"))
    return intake.sync_summary(messages, _articles(spark, d))


@query(f"SELECT alert_name, count(*) AS article_count FROM ({_ARTICLES}) GROUP BY alert_name")
def alert_totals(spark, d):
    return intake.alert_totals(_articles(spark, d))


_LINT = [("invalid_frontmatter", "bad"), ("missing_title", "NOT bad AND title = ''"), ("missing_tags", "NOT bad AND doc_id % 5 = 0"), ("tags_not_list", "NOT bad AND doc_id % 5 = 1"), ("duplicate_tags", "NOT bad AND doc_id % 5 > 1 AND doc_id % 3 = 0"), ("empty_body", "doc_id % 7 = 0")]
_LINTED = f"(SELECT doc_id, lang || '/' || doc_id AS path, {joined(_LINT)} AS issues FROM (SELECT doc_id, lang, doc_id % 11 = 0 AS bad, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 't' END AS title FROM documents))"


def _linted(spark, d):
    tags = F.when(_doc() % 3 == 0, F.array(F.col("lang"), F.upper("lang"))).otherwise(F.array("lang"))
    return table(spark, d, "documents").select(F.concat_ws("/", "lang", _doc().cast("string")).alias("path"), F.when(_doc() % 11 == 0, "broken").alias("error"), F.when(_doc() % 13 == 0, " ").otherwise("t").alias("title"), tags.alias("tags"), F.when(_doc() % 5 > 0, _doc() % 5 > 1).alias("tags_is_list"), F.when(_doc() % 7 == 0, " \n").otherwise("b").alias("body"))


@query(f"SELECT path, issues FROM {_LINTED} WHERE issues <> ''")
def page_lint(spark, d):
    """What is wrong with the front matter of pages."""
    return catalog.lint(_linted(spark, d)).select("path", F.array_join("issues", ",").alias("issues"))


@query(f"SELECT count(*) AS scanned, count(*) FILTER (issues <> '') AS with_issues, (SELECT string_agg(path || '=' || issues, ';' ORDER BY path) FROM (SELECT * FROM {_LINTED} WHERE issues <> '' ORDER BY path LIMIT 5)) AS pages FROM {_LINTED}")
def lint_summary(spark, d):
    """How many pages were read and have something wrong, and the first of them."""
    shown = F.array_join(F.transform("pages", lambda p: F.concat(p["path"], F.lit("="), F.array_join(p["issues"], ","))), ";")
    return catalog.lint_summary(_linted(spark, d), 5).select("scanned", "with_issues", shown.alias("pages"))


@query(f"""
WITH c AS (SELECT *, (contains(lower(title), '1')::INT + contains(lower(alert_name), '1')::INT) * 3 AS hits FROM ({_ARTICLES}))
SELECT article_key, hits, score FROM c ORDER BY hits DESC, score DESC, status <> 'selected', lower(alert_name), lower(title) LIMIT 50""")
def topic_ranking(spark, d):
    """The best candidates of a topic."""
    hits = intake.topic_hits("1", {"title": F.col("title"), "alert_name": F.col("alert_name")})
    return intake.ranked_by_topic(_articles(spark, d).withColumn("hits", hits["hits"]), 50).select("article_key", "hits", "score")


@query(f"""
WITH a AS (SELECT *, {_SOURCE} AS source_url FROM ({_ARTICLES})), j AS ({_JOBS}), p AS ({_PAPERS}),
e AS (SELECT a.*, {_CANON.format('a.source_url')} AS canon FROM a LEFT JOIN p ON a.paper_key = p.paper_key WHERE a.status = 'selected' AND domain = 'en' AND score >= 0 AND processed_at IS NULL AND coalesce(workflow_state, 'discovered') NOT IN ('drafted', 'committed', 'pr_open', 'merged')
  AND NOT EXISTS (SELECT 1 FROM j WHERE j.article_key = a.article_key OR j.source_url = a.article_url OR j.source_url = a.scholar_url) AND a.source_url <> ''),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY score DESC, created_at, article_key) AS place FROM e) WHERE place = 1 AND canon NOT IN (SELECT {_CANON.format('source_url')} FROM j WHERE state NOT IN ('pr_open', 'duplicate', 'rejected', 'failed')))
SELECT (SELECT max(job_id) FROM j) + row_number() OVER (ORDER BY score DESC, created_at, article_key) AS job_id, article_key, source_url, canon AS canonical_source_url FROM f QUALIFY row_number() OVER (ORDER BY score DESC, created_at, article_key) <= 30""")
def queue_backlog(spark, d):
    """The articles of the backlog that get new jobs."""
    found = jobs.enqueue_backlog(_articles(spark, d), _papers(spark, d), _jobs(spark, d), "selected", "en", 0, 30)
    return found.select("job_id", "article_key", "source_url", "canonical_source_url")


@query(f"""
WITH a AS (SELECT *, {_SOURCE} AS source_url FROM ({_ARTICLES})), j AS (SELECT * FROM ({_JOBS}) WHERE state NOT IN ('pr_open', 'duplicate', 'rejected', 'failed')), w AS (SELECT *, {_CANON.format('source_url')} AS canon FROM a WHERE source_url <> ''),
m AS (SELECT w.article_key, max(job_id) AS job_id FROM w JOIN j ON j.article_key = w.article_key OR j.source_url = w.source_url OR {_CANON.format('j.source_url')} = w.canon GROUP BY 1),
n AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY canon ORDER BY article_key) AS place FROM w WHERE article_key NOT IN (SELECT article_key FROM m)) WHERE place = 1)
SELECT m.job_id, false AS created, article_key, j.state FROM m JOIN j USING (job_id) UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY article_key), true, article_key, 'queued' FROM n""".replace("SELECT m.job_id, false AS created, article_key, j.state FROM m JOIN j USING (job_id)", "SELECT m.job_id, false AS created, m.article_key, j.state FROM m JOIN j ON m.job_id = j.job_id"))
def queue_articles(spark, d):
    """A job for each article that is named, or the active job that is about it already."""
    a = _articles(spark, d)
    found = jobs.enqueue(a, _jobs(spark, d), a.select(F.col("article_key").alias("identifier")), "en")
    return found.select("job_id", "created", "article_key", "state")


_SEVERITIES = ("warning", "review", "blocking")
_ISSUE_LIST = f"list_transform(range(event_id % 4), lambda i: ([{', '.join(quoted(x) for x in _SEVERITIES)}])[1 + (event_id + i) % 3])"


@query(f"""
WITH a AS (SELECT user_id, event_id, event_id % 9 = 0 AS approved, {_ISSUE_LIST} AS s FROM events),
q AS (SELECT *, len(list_filter(s, lambda x: x = 'blocking')) AS b, len(list_filter(s, lambda x: x <> 'warning')) AS c FROM a)
SELECT user_id, 'plan ' || arg_min(event_id, (NOT approved, b, c, event_id)) AS plan, min((NOT approved, b, c, event_id))[2]::INT AS blocking FROM (SELECT * FROM q) GROUP BY user_id""".replace("min((NOT approved, b, c, event_id))[2]::INT", "arg_min(b, (NOT approved, b, c, event_id))::INT"))
def best_plans(spark, d):
    """Of the attempts of a source the approved one, else the one with fewest issues."""
    e = F.col("event_id")
    issues = F.when(e % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), e % 4 - 1), lambda i: F.struct(F.element_at(F.array(*map(F.lit, _SEVERITIES)), ((e + i) % 3 + 1).cast("int")).alias("severity"))))
    a = table(spark, d, "events").select("user_id", F.concat(F.lit("plan "), e.cast("string")).alias("plan"), F.when(e % 9 == 0, F.lit(True)).alias("approved"), issues.alias("issues"), e.alias("attempt"))
    return packets.best_plan(a, "user_id").select("user_id", "plan", "blocking")


@query(f"SELECT user_id AS review_id, count(*) AS issues, count(*) FILTER (s = 'blocking') AS blocking, count(*) FILTER (s IN ('review', 'blocking')) AS actionable FROM (SELECT user_id, {pick_sql((*_SEVERITIES, None), 'event_id')} AS s FROM events) GROUP BY user_id")
def finding_counts(spark, d):
    """Issues of each review by severity."""
    e = table(spark, d, "events").select(F.col("user_id").alias("review_id"), pick((*_SEVERITIES, None), F.col("event_id")).alias("severity"))
    return validate.finding_counts(e)


_CODES = ("limitation_omitted", "unsupported_claim", "wrong_target_page")


@query(f"""
WITH e AS (SELECT event_id, user_id, {pick_sql(_SEVERITIES, 'event_id')} AS severity, {pick_sql(_CODES, 'event_id // 3')} AS code, event_id % 7 > 0 AS accepted FROM events),
r AS (SELECT user_id AS review_id, count(*) FILTER (accepted AND severity <> 'warning') AS actionable, count(*) FILTER (accepted AND severity = 'blocking') AS blocking, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted AND code = 'wrong_target_page' AND severity <> 'warning') AS entity_rejections, count(*) FILTER (accepted AND code = 'limitation_omitted' AND severity <> 'warning') AS balance FROM e GROUP BY 1)
SELECT *, CASE WHEN actionable = 0 THEN 'approve' WHEN blocking > 0 THEN 'needs_review' ELSE 'revise' END AS recommendation FROM r""")
def review_decisions(spark, d):
    """Accepted issues of reviews as decisions."""
    e = F.col("event_id")
    t = table(spark, d, "events").select(F.col("user_id").alias("review_id"), pick(_SEVERITIES, e).alias("severity"), pick(_CODES, F.floor(e / 3)).alias("code"), (e % 7 > 0).alias("accepted"))
    return validate.combine_reviews(t)


@query(f"""
SELECT event_id, NOT coalesce(event_id % 5 = 0, false) AND (event_id % 4 = 0 OR event_id % 3 = 0) AS blocks, event_id % 2 = 0 AS repairable, {pick_sql(('already_cited', 'append_existing', 'new_article'), 'event_id')} AS action FROM events""")
def review_gates(spark, d):
    """Whether reviews stop a plan, whether findings on what it leaves out can be repaired, and what to do with a source."""
    e = F.col("event_id")
    reviews = F.when(e % 4 == 0, F.array().cast("array<string>")).when(e % 3 == 0, F.array(F.lit("approve"), F.lit("needs_review"))).otherwise(F.array(F.lit("revise"), F.lit("approve")))
    t = table(spark, d, "events").select("event_id", reviews.alias("r"), F.lit("limitation_omitted").alias("code"), F.lit("review").alias("severity"), F.lit("only in rats").alias("evidence"), F.when(e % 2 == 0, "in rats").otherwise("in mice").alias("source_quote"))
    found = validate.balance_findings(t)
    return found.select("event_id", validate.blocks_publication(e % 5 == 0, F.col("r")).alias("blocks"), "repairable", validate.suggested_action(e % 3 == 0, e % 3 == 1).alias("action"))


_CITED_SETS = ((), ("[1]",), ("[1]", "[Smith 2019](#r)"), ("[3]", "[1]"))


@query("SELECT doc_id, doc_id % 4 IN (0, 1, 2) AS covered FROM documents")
def marker_coverage(spark, d):
    """Whether all citations of a text stand among those that a plan represents."""
    sets = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in _CITED_SETS]
    cited = F.when(_doc() % 4 == 0, sets[0]).when(_doc() % 4 == 1, sets[1]).when(_doc() % 4 == 2, sets[2]).otherwise(sets[3])
    return table(spark, d, "documents").select("doc_id", validate.markers_covered(cited, F.array(F.lit("[Smith 2019]"), F.lit("[1]"))).alias("covered"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1234/a' || page_id || ' 10.1234/a' || page_id || ' ' ELSE '' END || url AS identifiers FROM pages""")
def source_identifiers(spark, d):
    """What a source may be known by, each form once."""
    n = F.col("page_id").cast("string")
    found = packets.identifiers(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.1234/a"), n)).otherwise("none"), F.col("url"), F.concat(F.upper("url"), F.lit("/")), F.lit(" "))
    return table(spark, d, "pages").select("page_id", F.array_join(found, " ").alias("identifiers"))


_GATE_TITLES, _GATE_DOIS, _GATE_NAMES, _GATE_DATES = ("Fine", "", "Access denied"), ("10.1234/x", "bad", ""), ("A. Author", "Unknown", "authors"), ("2024", "n/a", "")
_GATED = sorted(
    [
        ("doi_title_mismatch", "doc_id % 17 = 0"),
        ("invalid_title", "title = '' OR title = 'Access denied'"),
        ("insufficient_source_evidence", "length(a) < 120 AND length(b) < 800"),
        ("invalid_doi", "doi = 'bad'"),
        ("missing_or_placeholder_authors", "authors <> 'A. Author'"),
        ("missing_or_placeholder_journal", "false"),
        ("missing_or_placeholder_pub_date", "pub_date <> '2024'"),
        ("invalid_reference_url", "doc_id % 4 = 3"),
        ("doi_reference_url_mismatch", "doc_id % 4 < 3 AND doi <> '' AND url <> 'https://doi.org/' || doi"),
        ("truncated_abstract", "ends_with(a, '...')"),
    ]
)


@query(f"""
WITH p AS (SELECT doc_id, {pick_sql(_GATE_TITLES, 'doc_id')} AS title, {pick_sql(_GATE_DOIS, 'doc_id // 3')} AS doi, {pick_sql(_GATE_NAMES, 'doc_id // 5')} AS authors, {pick_sql(_GATE_DATES, 'doc_id // 7')} AS pub_date,
  CASE WHEN doc_id % 5 = 0 THEN 'cut ...' ELSE trim(substr({collapsed('text')}, 1, 150)) END AS a, CASE WHEN doc_id % 2 = 0 THEN trim({collapsed('text')}) ELSE '' END AS b, CASE WHEN doc_id % 4 = 3 THEN 'nowhere' ELSE 'https://doi.org/10.1234/x' END AS url FROM documents), g AS (SELECT doc_id, {joined(_GATED)} AS issues FROM p)
SELECT doc_id, issues, issues = '' AS ok FROM g""")
def packet_gate(spark, d):
    """What keeps packets from being used."""
    short = F.trim(F.substring(text.collapse("text"), 1, 150))
    t = table(spark, d, "documents").select(
        "doc_id", pick(_GATE_TITLES, _doc()).alias("title"), pick(_GATE_DOIS, F.floor(_doc() / 3)).alias("doi"), pick(_GATE_NAMES, F.floor(_doc() / 5)).alias("authors"), F.lit("A journal").alias("journal"), pick(_GATE_DATES, F.floor(_doc() / 7)).alias("pub_date"),
        F.when(_doc() % 5 == 0, "cut ...").otherwise(short).alias("abstract"), F.when(_doc() % 2 == 0, text.collapse("text")).otherwise("").alias("body_markdown"), F.when(_doc() % 4 == 3, "nowhere").otherwise("https://doi.org/10.1234/x").alias("reference_url"),
        F.when(_doc() % 17 == 0, F.array(F.lit("doi_title_mismatch"), F.lit("content_too_short"))).alias("retrieval_issues"), F.lit(None).cast("array<string>").alias("consistency"),
    )
    return packets.gate(t).select("doc_id", F.array_join("issues", ",").alias("issues"), "ok")


_ABSTRACTS = ("A short one", "Cut here ...", "", "Text is machine generated by x")


@query(f"""
WITH x AS (SELECT doc_id, {pick_sql(_ABSTRACTS, 'doc_id')} AS s, trim(substr({collapsed('text')}, 1, 200)) AS l FROM documents),
c AS (SELECT doc_id, trim(regexp_extract(s, '^(.*?)(?:Text is machine generated.*)?$', 1)) AS s, l, CASE WHEN doc_id % 3 = 0 THEN l ELSE '' END AS second FROM x)
SELECT doc_id, CASE WHEN length(second) >= 120 AND NOT ends_with(second, '...') AND NOT ends_with(second, '…') THEN second WHEN s <> '' THEN s ELSE second END AS abstract,
  CASE WHEN length(l) <= 60 AND NOT ends_with(l, '...') AND NOT ends_with(l, '…') AND l <> '' AND (length(l) >= length(s) OR ends_with(s, '...') OR s = '') THEN l WHEN s <> '' AND NOT ends_with(s, '...') THEN s WHEN s <> '' AND (length(l) > 60 OR l = '') THEN s ELSE CASE WHEN length(l) <= 60 AND length(l) > length(s) THEN l ELSE s END END AS title FROM c""")
def chosen_texts(spark, d):
    """The abstract of the first group that has a whole one, and the longest whole title that fits."""
    long_ = F.trim(F.substring(text.collapse("text"), 1, 200))
    s = pick(_ABSTRACTS, _doc())
    clean = F.trim(F.substring_index(s, "Text is machine generated", 1))
    return table(spark, d, "documents").select("doc_id", packets.choose_abstract([F.array(s), F.array(F.when(_doc() % 3 == 0, long_).otherwise(""))]).alias("abstract"), values.choose_complete(F.array(long_, clean), 60).alias("title"))


_MINED = (
    "Blood pressure fell by 12 mmhg with p < 0 05 in the group that took it and in no other one at all.",
    "The objective was to evaluate the effect of citrus on blood pressure in people who had taken none of it before this work began.",
    "Citrus intake increased the antioxidant capacity of plasma over weeks in a way that lasted.",
    "Traditional folk use of citrus for diabetes is well known in many places and old books.",
    "Nothing of note is said here, but at some length so that it would fit if it were wanted.",
    "The method was used in citrus work that improved traditional uses of it and more besides.",
)
_MINE = [("results", r"\bresults?\b|\boutcomes?\b", 60, 420, matches("k", classify.QUANTITY)), ("theses", packets._THESIS_SECTION, 100, 650, f"{matches('k', packets.AIM)} AND {matches('k', packets.AIM_OF)}"), ("background", packets._BACKGROUND_SECTION, 55, 700, f"{matches('k', packets.BACKGROUND)} AND NOT {matches('k', classify.METHODS)} AND NOT {matches('k', packets.OWN_STUDY)} AND contains(' ' || k || ' ', ' citrus ')")]


@query(
    "WITH s AS (SELECT doc_id, pos, h, x, " + _key("x") + " AS k, " + _key("h") + " AS kh FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS pos, {pick_sql(_HEADINGS, f'doc_id + {i}')} AS h, {pick_sql(_MINED, f'doc_id // 8 + {i}')} AS x FROM documents" for i in range(5)) + "))\n"
    + "\nUNION ALL ".join(f"SELECT doc_id, '{name}' AS kind, rank::INT AS rank, x AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM s WHERE {matches('kh', heading)} AND length(x) BETWEEN {least} AND {most} AND {test}) WHERE rank <= 2" for name, heading, least, most, test in _MINE)
    + f"\nUNION ALL SELECT doc_id, 'core', rank::INT, x FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM s WHERE length(x) BETWEEN 55 AND 700 AND {matches('k', packets.OUTCOME)} AND NOT {matches('k', classify.METHODS)} AND contains(' ' || k || ' ', ' citrus ')) WHERE rank <= 2"
)
def mined_sentences(spark, d):
    """Candidate sentences of four kinds from sections and abstracts."""
    docs = table(spark, d, "documents")
    parts = F.array(*[F.struct(pick(_HEADINGS, _doc() + i).alias("heading"), pick(_MINED, F.floor(_doc() / 8) + i).alias("x")) for i in range(5)])
    sections = docs.select("doc_id", F.posexplode(parts).alias("pos", "s")).select("doc_id", "pos", "s.heading", F.concat(F.lit("## "), "s.heading", F.lit("\n\n"), "s.x").alias("text"))
    abstracts = docs.select("doc_id", F.array_join(F.transform(parts, lambda s: s["x"]), " ").alias("abstract"))
    citrus = F.lit("Citrus")
    found = {"results": packets.quantitative_results(sections, "doc_id", 2), "theses": packets.theses(sections, "doc_id", 2), "background": packets.background_claims(sections, "doc_id", citrus, 2), "core": packets.core_results(abstracts, "doc_id", F.col("abstract"), citrus, 2)}
    out = None
    for kind, df in found.items():
        df = df.select("doc_id", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), "sentence")
        out = df if out is None else out.unionAll(df)
    return out


_PHRASES = ("gut", "berry", "ess", "blood pressure", "", "day")
_SAID = ("The guts of it", "many berries", "of esss", "blood pressures rose", "a day or two", "days", "nothing")


@query(f"""
WITH p AS (SELECT doc_id, {pick_sql(_PHRASES, 'doc_id')} AS p, {_key(f"{pick_sql(_SAID, 'doc_id // 6')} || ' ' || source")} AS t FROM documents),
v AS (SELECT *, CASE WHEN ends_with(p, 's') THEN p WHEN regexp_matches(p, '[^ ]{{2}}y$') THEN regexp_replace(p, 'y$', 'ies') ELSE p || 's' END AS pl FROM p)
SELECT doc_id, p <> '' AND (contains(' ' || t || ' ', ' ' || p || ' ') OR contains(' ' || t || ' ', ' ' || pl || ' ')) AS has, CASE WHEN p = '' OR t = '' THEN 0 ELSE (length(' ' || t || ' ') - length(replace(' ' || t || ' ', ' ' || p || ' ', '')))  // (length(p) + 2) END::INT AS times FROM v""")
def phrase_hits(spark, d):
    """Phrases in texts as whole words, also in the plural, and how often."""
    t = table(spark, d, "documents").select("doc_id", pick(_PHRASES, _doc()).alias("p"), text.key(F.concat(pick(_SAID, F.floor(_doc() / 6)), F.lit(" "), "source")).alias("t"))
    return t.select("doc_id", text.has_phrase(F.col("t"), F.col("p")).alias("has"), text.phrase_count(F.col("t"), F.col("p")).cast("int").alias("times"))


@query("""
SELECT doc_id, substr('---' || chr(10) || 'title: ' || lang || chr(10) || '---' || chr(10) || chr(10) || '## One' || chr(10) || '### Two ' || source || chr(10) || chr(10) || '# ' || lang || chr(10) || '## One' || chr(10) || 'text' || chr(10) || '### Two ' || source || chr(10) || 'end', 1, 70) AS digest FROM documents""")
def page_digests(spark, d):
    """Front matter, headings and the start of pages, up to a length."""
    page = F.concat(F.lit("---\ntitle: "), "lang", F.lit("\n---\n# "), "lang", F.lit("\n## One\ntext\n### Two "), "source", F.lit("\nend"))
    return table(spark, d, "documents").select("doc_id", packets.page_digest(page, 70).alias("digest"))


@query("""
SELECT doc_id, 'S' || doc_id AS doi, lang || ' title' AS title, CASE WHEN doc_id % 3 = 0 THEN 'A B, C' ELSE '' END AS authors, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS journal, CASE doc_id % 4 WHEN 0 THEN '2024-03-09' WHEN 1 THEN '2023-11' WHEN 2 THEN '2022' ELSE '' END AS pub_date, 'Bold ' || lang AS abstract, doc_id / 2.0 AS score FROM documents""")
def registry_records(spark, d):
    """Records of a registry as flat rows."""
    n = _doc().cast("string")
    author = F.when(_doc() % 3 == 0, F.lit('"author": [{"given": "A", "family": " B"}, {"family": "C"}, {"given": ""}], ')).otherwise("")
    date = F.when(_doc() % 4 == 0, F.lit('"issued": {"date-parts": [[2020]]}, "published-print": {"date-parts": [[2024, 3, 9]]}, ')).when(_doc() % 4 == 1, F.lit('"published-online": {"date-parts": [[2023, 11]]}, ')).when(_doc() % 4 == 2, F.lit('"issued": {"date-parts": [[2022]]}, ')).otherwise("")
    journal = F.when(_doc() % 2 == 0, F.concat(F.lit('"container-title": ["'), "source", F.lit('", "x"], '))).otherwise("")
    work = F.concat(F.lit('{"DOI": " S'), n, F.lit('", "title": ["'), "lang", F.lit('  title"], '), author, date, journal, F.lit('"abstract": "<p><b>Bold</b> '), "lang", F.lit('</p>", "score": '), (_doc() / 2).cast("string"), F.lit("}"))
    return table(spark, d, "documents").select("doc_id", packets.registry_summary(work).alias("r")).select("doc_id", "r.doi", "r.title", "r.authors", "r.journal", "r.pub_date", "r.abstract", "r.score")


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'forced' WHEN event_id % 5 = 0 THEN 'primary_fetch_failed: no ' || event_type WHEN event_id % 3 = 0 THEN 'no_primary_data' WHEN event_id % 2 = 0 THEN 'body_missing,title_missing' ELSE '' END AS reasons FROM events""")
def fallback_reasons(spark, d):
    """Why a second way to read a source was tried."""
    e = F.col("event_id")
    issues = F.when(e % 2 == 0, F.array(F.lit("body_missing"), F.lit("title_missing")))
    found = packets.fallback_reasons(issues, F.when(e % 5 == 0, F.concat(F.lit("no "), "event_type")), e % 3 != 0, e % 7 == 0)
    return table(spark, d, "events").select("event_id", F.array_join(found, ",").alias("reasons"))


@query("""
WITH p AS (SELECT doc_id, lang, source, doc_id % 4 = 0 AS untitled FROM documents), r AS (SELECT doc_id % 100 AS d, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT doc_id, 'en/' || doc_id AS path FROM documents WHERE doc_id % 3 = 0) GROUP BY 1)
SELECT p.doc_id::VARCHAR AS packet_id, CASE WHEN untitled THEN 'Untitled research source' ELSE 'T ' || lang END AS proposed_title, lang || '|' || source AS source_entities, CASE doc_id % 3 WHEN 0 THEN 'animal' WHEN 1 THEN 'Review' ELSE 'unspecified' END AS evidence_scope, coalesce(paths, '') AS rejected FROM p LEFT JOIN r ON p.doc_id = r.d""")
def page_recommendations(spark, d):
    """Records that recommend a new page to a person, with the pages that were rejected."""
    docs = table(spark, d, "documents")
    p = docs.select(_doc().cast("string").alias("packet_id"), F.when(_doc() % 4 == 0, "").otherwise(F.concat(F.lit("T "), "lang")).alias("title"), F.concat("lang", F.lit(", ;"), "source").alias("keywords"), F.when(_doc() % 3 == 0, "in rats").otherwise("in people").alias("abstract"), F.when(_doc() % 3 == 1, "Review").otherwise("").alias("study_type"))
    rejected = docs.where("doc_id % 3 = 0").select((_doc() % 100).cast("string").alias("packet_id"), F.concat(F.lit("en/"), _doc().cast("string")).alias("path"), F.lit("t").alias("title"))
    found = packets.new_page_recommendation(p, rejected, F.lit("no page"))
    return found.select("packet_id", "proposed_title", F.array_join("source_entities", "|").alias("source_entities"), "evidence_scope", F.array_join(F.transform("rejected_existing_targets", lambda x: x["path"]), ",").alias("rejected"))


@query("""
WITH o AS (SELECT conv_id::VARCHAR || '/' || turn AS id, role, text FROM conversations WHERE turn % 3 < 2), n AS (SELECT conv_id::VARCHAR || '/' || turn AS id, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'new' END AS role, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'x' END AS text FROM conversations WHERE turn % 3 > 0)
SELECT coalesce(o.id, n.id) AS message_id, CASE WHEN o.id IS NOT NULL THEN o.role ELSE n.role END AS thread_id, md5(coalesce(n.text, o.text)) AS snippet FROM o FULL JOIN n ON o.id = n.id""")
def upsert_messages(spark, d):
    """Messages merged: what is new wins where it is there, but threads stay."""
    c = table(spark, d, "conversations").withColumn("message_id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    t = F.col("turn")
    old = c.where(t % 3 < 2).select("message_id", F.col("role").alias("thread_id"), F.col("text").alias("snippet"))
    new = c.where(t % 3 > 0).select("message_id", F.when(t % 2 == 0, None).otherwise(F.lit("new")).alias("thread_id"), F.when(t % 4 == 0, None).otherwise(F.lit("x")).alias("snippet"))
    return papers.upsert_messages(old, new).withColumn("snippet", F.md5(F.col("snippet").cast("binary")))


@query("""
WITH o AS (SELECT doc_id::VARCHAR AS k, 'old' AS title, lang AS status, n_chars AS score FROM documents WHERE doc_id % 3 < 2), n AS (SELECT doc_id::VARCHAR AS k, 'new' AS title, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'review' END AS status, 0 AS score FROM documents WHERE doc_id % 3 > 0)
SELECT coalesce(o.k, n.k) AS article_key, coalesce(o.title, n.title) AS title, CASE WHEN n.k IS NOT NULL THEN n.status ELSE o.status END AS status, CASE WHEN n.k IS NOT NULL THEN n.score ELSE o.score END::BIGINT AS score FROM o FULL JOIN n ON o.k = n.k""")
def upsert_articles(spark, d):
    """Articles merged: what was parsed is refreshed, titles stay."""
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 3 < 2").select(_doc().cast("string").alias("article_key"), F.lit("old").alias("title"), F.col("lang").alias("status"), F.col("n_chars").cast("long").alias("score"))
    new = docs.where("doc_id % 3 > 0").select(_doc().cast("string").alias("article_key"), F.lit("new").alias("title"), F.when(_doc() % 2 != 0, "review").alias("status"), F.lit(0).cast("long").alias("score"))
    return papers.upsert_articles(old, new)


@query(f"""
WITH a AS ({_ARTICLES}), hit AS (SELECT article_key FROM a WHERE paper_key IN (SELECT 'p' || i FROM range(0, 200, 3) t(i)) OR article_url IN (SELECT 'http://www.en.org/' || i FROM range(40) t(i)) OR scholar_url IN (SELECT 'http://s.org/' || i FROM range(0, 500, 7) t(i)))
SELECT article_key, coalesce(processed_at, CASE WHEN article_key IN (SELECT article_key FROM hit) THEN {_NOW_SQL} END) AS processed_at, CASE WHEN doc % 4 = 1 THEN 'rejected' ELSE status END AS status, CASE WHEN doc % 4 = 1 THEN {_NOW_SQL} ELSE updated_at END AS updated_at FROM (SELECT *, article_key::INT AS doc FROM a)""")
def article_marks(spark, d):
    """Articles marked as processed by paper or url, and set to a status by key."""
    a = _articles(spark, d)
    probe = lambda n, step, prefix: spark.range(0, n, step).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("identifier"))
    probes = probe(200, 3, "p").union(probe(40, 1, "http://www.en.org/")).union(probe(500, 7, "http://s.org/"))
    marked = papers.mark_processed_by(a, probes, _now())
    return papers.set_status(marked, a.where(F.col("article_key").cast("int") % 4 == 1), "rejected", _now()).select("article_key", "processed_at", "status", "updated_at")


@query(f"""
WITH a AS ({_ARTICLES}), f AS (SELECT * FROM a WHERE paper_key IS NULL AND status = 'selected' ORDER BY score DESC, created_at, article_key LIMIT 40)
SELECT article_key, sha256('url:' || {_CANON.format('s')}) AS paper_key, {_CANON.format('s')} AS canonical_url FROM (SELECT *, {_SOURCE} AS s FROM f) WHERE s <> ''""")
def key_backfill(spark, d):
    """Articles without a paper, with the identity that they would get."""
    return papers.backfill_keys(_articles(spark, d), "selected", 40).select("article_key", "paper_key", "canonical_url")


@query(f"""
SELECT article_key, coalesce(paper_key, CASE WHEN {_SOURCE} <> '' THEN sha256('url:' || {_CANON.format(_SOURCE)}) END) AS paper_key, CASE WHEN paper_key IS NULL AND {_SOURCE} <> '' THEN {_NOW_SQL} ELSE updated_at END AS updated_at FROM ({_ARTICLES})""")
def keys_applied(spark, d):
    """All articles after the back-fill of their papers' keys."""
    a = _articles(spark, d)
    return papers.apply_keys(a, papers.backfill_keys(a), _now()).select("article_key", "paper_key", "updated_at")


@query("SELECT conv_id, turn, right(coalesce(role, '') || text, 150) AS log FROM conversations")
def appended_logs(spark, d):
    """Logs with a chunk appended, of which the last characters stay."""
    return table(spark, d, "conversations").select("conv_id", "turn", papers.append_log(F.col("role"), F.col("text"), 150).alias("log"))


_TO = ("retry", "pr_open", "matching", "nonsense", "validated")
_CHANGES = f"SELECT event_id AS job_id, {pick_sql(_TO, 'event_id')} AS to_state, {pick_sql(('w1', None, ''), 'event_id // 5')} AS worker FROM events WHERE event_id % 2 = 0"
_TAKEN = "to_state IN ('retry', 'pr_open', 'matching', 'validated') AND (coalesce(worker, '') = '' OR lease_owner IS NULL OR worker = lease_owner)"


def _changes(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").where("event_id % 2 = 0").select(e.alias("job_id"), pick(_TO, e).alias("state"), pick(("w1", None, ""), F.floor(e / 5)).alias("worker"))


@query(f"""
WITH j AS ({_JOBS}), c AS ({_CHANGES}), x AS (SELECT j.*, to_state, coalesce({_TAKEN}, false) AS ok, to_state IN ('pr_open', 'validated') AS done FROM j LEFT JOIN c USING (job_id))
SELECT job_id, CASE WHEN ok THEN to_state ELSE state END AS state, CASE WHEN ok AND (done OR to_state = 'retry') THEN NULL ELSE lease_owner END AS lease_owner,
  CASE WHEN ok AND to_state = 'retry' THEN {_NOW_SQL} + INTERVAL 1 SECOND * least(300 * pow(2, greatest(attempt_count - 1, 0)), 21600)::INT WHEN ok THEN NULL ELSE next_run_at END AS next_run_at,
  CASE WHEN ok AND done THEN {_NOW_SQL} WHEN ok AND to_state = 'retry' THEN NULL ELSE finished_at END AS finished_at FROM x""")
def job_changes(spark, d):
    """Jobs after changes of state: leases of others and unknown states are refused, retries wait."""
    return jobs.set_state(_jobs(spark, d), _changes(spark, d), _now()).select("job_id", "state", "lease_owner", "next_run_at", "finished_at")


@query(f"SELECT job_id, state AS from_state, to_state, {_NOW_SQL} AS created_at FROM ({_JOBS}) JOIN ({_CHANGES}) USING (job_id) WHERE {_TAKEN}")
def job_change_events(spark, d):
    """The log rows of the changes that are taken."""
    return jobs.state_events(_jobs(spark, d), _changes(spark, d), _now())


@query(f"""
SELECT job_id, CASE WHEN hit THEN 'queued' ELSE state END AS state, CASE WHEN hit THEN 0 ELSE attempt_count END AS attempt_count, CASE WHEN NOT hit THEN run_id END AS run_id, CASE WHEN NOT hit THEN pr_url END AS pr_url, CASE WHEN NOT hit THEN error END AS error, CASE WHEN hit THEN {_NOW_SQL} ELSE updated_at END AS updated_at
FROM (SELECT *, job_id % 3 < 2 AND state IN ('validated', 'needs_review', 'failed', 'rejected') AS hit FROM ({_JOBS}))""")
def requeued_jobs(spark, d):
    """Stopped jobs back in the queue, without their outputs."""
    j = _jobs(spark, d)
    return jobs.requeue(j, j.where("job_id % 3 < 2"), _now()).select("job_id", "state", "attempt_count", "run_id", "pr_url", "error", "updated_at")


@query(f"""
SELECT job_id, state AS from_state, 'queued' AS to_state, '{{"action":"explicit_requeue","reason":"again","prior_outputs":{{' || concat_ws(',', CASE WHEN run_id <> '' THEN '"run_id":"' || run_id || '"' END, CASE WHEN pr_url IS NOT NULL THEN '"pr_url":"' || pr_url || '"' END) || '}}}}' AS detail_json FROM ({_JOBS}) WHERE job_id % 3 < 2 AND state IN ('validated', 'needs_review', 'failed', 'rejected')""")
def requeue_events(spark, d):
    """The log rows of requeued jobs, with what they lose."""
    j = _jobs(spark, d)
    return jobs.requeue_events(j, j.where("job_id % 3 < 2"), " again ", _now()).select("job_id", "from_state", "to_state", "detail_json")


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 > 0 THEN 'completed' ELSE 'failed' END AS state, CASE WHEN event_id % 4 > 0 THEN 'https://github.com/o/r/pull/' || event_id END AS pr_url FROM events""")
def job_outcomes(spark, d):
    """Whether background jobs succeeded, by exit code and what they printed."""
    e = F.col("event_id")
    log = F.when(e % 4 > 0, F.concat(F.lit("see https://github.com/o/r/pull/1 then\nhttps://github.com/o/r/pull/"), e.cast("string"), F.lit(" done"))).otherwise("nothing")
    return table(spark, d, "events").select("event_id", jobs.outcome(log, e % 3).alias("o")).select("event_id", "o.state", "o.pr_url")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# T' || chr(10) || chr(10) || '## A' || chr(10) || 'one' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '[^1]: x' || chr(10)
  WHEN 1 THEN '# T' || chr(10) || chr(10) || '## A' || chr(10) || 'one' || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '## New' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) || '[^1]: x' || chr(10)
  WHEN 2 THEN '# T' || chr(10) || chr(10) || '## A' || chr(10) || 'one' || chr(10) || chr(10) || '### Sub' || chr(10) || chr(10) || '- ' || lang || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '[^1]: x' || chr(10) END AS page, doc_id % 4 = 3 AS refused FROM documents""")
def inserted_blocks(spark, d):
    """Blocks put under headings that are there, are new, or belong below another one."""
    page = F.lit("# T\n\n## A\none\n\n## B\n\n[^1]: x\n")
    heading = pick(("## A", "## New", "### Sub", "#### Deep"), _doc())
    parent = F.when(_doc() % 4 >= 2, "## A").otherwise("")
    done = editing.inserted(page, heading, parent, F.concat(F.lit("- "), "lang"))
    return table(spark, d, "documents").select("doc_id", done.alias("x")).select("doc_id", "x.page", F.col("x.error").isNotNull().alias("refused"))


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 6 END AS number, '### Lipids' || chr(10) || chr(10) || '- a ' || lang || '[^3]' || chr(10) || '- c[^3]' || chr(10) || chr(10) || '- b[^3]' AS block, CASE WHEN doc_id % 2 = 0 THEN 'The Title' WHEN lang = 'en' THEN 'Of en' ELSE 'Of ' || lang END AS title, '  <!-- review blocking ' || source || ': a - -> b -->' AS comment FROM documents""")
def rendered_bullets(spark, d):
    """Numbers of shared references, bullets by sub-section, clean titles and findings as comments."""
    page = F.lit("x\n\n[^2]: [A](http://a.org) 10.1/ABC\n[^5]: [B](http://b.org/x)")
    number = editing.shared_reference(page, F.when(_doc() % 3 == 0, "10.1/abc").otherwise(""), F.when(_doc() % 3 == 1, "HTTP://b.org/X").otherwise("http://none.org"))
    bullet = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("subsection"))
    block = editing.bullet_block(F.array(bullet(F.concat(F.lit("a "), "lang"), "Lipids"), bullet(F.lit("b"), ""), bullet(F.lit("c"), "Lipids")), F.lit(3))
    title = editing.clean_title(F.when(_doc() % 2 == 0, " the  title | Some Journal").otherwise(F.concat(F.lit("Of "), "lang", F.lit(" - Press"))), F.when(_doc() % 2 == 0, "The Title"))
    return table(spark, d, "documents").select("doc_id", number.cast("int").alias("number"), block.alias("block"), title.alias("title"), editing.annotation(F.col("source"), F.lit("blocking"), F.lit("a --> b")).alias("comment"))


@query("SELECT lang || '/' || doc_id AS path, 'gone-' || source AS anchor FROM documents WHERE doc_id % 2 = 0")
def dead_anchors(spark, d):
    """Links to places that a page doesn't have."""
    body = F.concat(F.lit('# Top of it\n[a](#top-of-it) [b](#here) <a id="here"></a>\n'), F.when(_doc() % 2 == 0, F.concat(F.lit("[c](#gone-"), "source", F.lit(")"))).otherwise(""))
    return catalog.dead_anchors(table(spark, d, "documents").select(F.concat_ws("/", "lang", _doc().cast("string")).alias("path"), body.alias("body")))


_RENDERED = sorted([("frontmatter_changed", "doc_id % 7 = 0"), ("reference_missing", "doc_id % 5 = 0"), ("duplicate_source_footnote", "doc_id % 3 = 0"), ("bullet_citation_missing", "doc_id % 4 = 0"), ("dead_anchor_link", "doc_id % 6 = 0"), ("change_scope_too_large", "doc_id % 9 = 0"), ("doi_missing_from_reference", "doc_id % 5 = 0 AND doc_id % 3 > 0"), ("source_url_missing_from_reference", "false")])


@query(f"SELECT doc_id, {joined(_RENDERED)} AS issues FROM documents")
def rendered_issues(spark, d):
    """What is wrong with changed pages."""
    before = F.lit("---\ntitle: a\n---\n# A\n")
    reference = F.when(_doc() % 5 == 0, "").otherwise("[^4]: [S](http://u.org) 10.1/x\n")
    again = F.when(_doc() % 3 == 0, "[^8]: [S](http://v.org) 10.1/X\n[^9]: 10.1/x\n").otherwise("")
    after = F.concat(F.when(_doc() % 7 == 0, "---\ntitle: b\n---\n# A\n").otherwise("---\ntitle: a\n---\n# A\n"), F.when(_doc() % 4 == 0, "- said\n").otherwise("- said[^4]\n"), F.when(_doc() % 6 == 0, "[x](#nowhere)\n").otherwise("[x](#a)\n"), F.when(_doc() % 9 == 0, F.lit("line\n" * 200)).otherwise(""), F.lit("http://u.org\n"), reference, again)
    found = editing.rendered_issues(before, after, F.lit(4), F.lit("10.1/x"), F.lit("http://u.org"), F.array(F.lit("said")))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))


_HINTS = (("invalid_heading", "Use a heading"), ("quote_not", "Quote the source"), ("bullet", "Mind the bullets"))


@query("""
SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'Use a heading' END, CASE WHEN doc_id % 3 = 0 THEN 'Quote the source' END, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 'Mind the bullets' END) AS hints, doc_id % 4 < 2 AS kept FROM documents""")
def repair_rules(spark, d):
    """Hints for a second try, and whether it keeps the texts of the first."""
    issues = F.array_compact(F.array(F.when(_doc() % 2 == 0, "target_0_invalid_heading"), F.when(_doc() % 3 == 0, "target_0_bullet_1_quote_not_in_source"), F.when(_doc() % 5 == 0, "target_1_bullet_count")))
    after = F.when(_doc() % 4 < 2, F.array(F.lit("all of a text"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    return table(spark, d, "documents").select("doc_id", F.array_join(validate.repair_hints(issues, list(_HINTS)), "|").alias("hints"), validate.repair_kept_bullets(F.array(F.lit("a text"), F.lit("")), after).alias("kept"))


_REVIEWED = sorted(
    [
        ("invalid_issue_code", "code = 'nonsense'"),
        ("invalid_severity", "severity IS NULL"),
        ("missing_explanation", "doc_id % 11 = 0"),
        ("invalid_bullet_index", "doc_id % 5 = 4"),
        ("source_quote_not_exact", "doc_id % 3 = 1"),
        ("missing_evidence_quote", "doc_id % 3 = 2"),
        ("evidence_review_requires_source_quote", "doc_id % 3 = 2"),
        ("self_contradictory_issue", "code = 'unsupported_claim' AND doc_id % 11 = 1"),
    ]
)


@query(f"""
WITH i AS (SELECT doc_id, {pick_sql(('unsupported_claim', 'merged_ideas', 'nonsense'), 'doc_id // 3')} AS code, {pick_sql(('warning', 'review', 'blocking', None), 'doc_id')} AS severity FROM documents), e AS (SELECT *, {joined(_REVIEWED)} AS errors FROM i)
SELECT doc_id, errors, CASE WHEN severity = 'warning' AND code = 'unsupported_claim' THEN 'review' ELSE severity END AS severity, errors = '' AS accepted FROM e""")
def review_issues(spark, d):
    """Issues of reviews with what is wrong with them, and their severity raised to the code's least."""
    t = table(spark, d, "documents").select(
        "doc_id", pick(("unsupported_claim", "merged_ideas", "nonsense"), F.floor(_doc() / 3)).alias("code"), pick(("warning", "review", "blocking", None), _doc()).alias("severity"), F.when(_doc() % 5 == 4, 9).when(_doc() % 5 == 3, None).otherwise((_doc() % 5).cast("int")).alias("bullet_index"), F.lit(3).alias("n_bullets"),
        F.when(_doc() % 11 == 0, " ").when(_doc() % 11 == 1, "No: it is supported.").otherwise("It is not.").alias("explanation"), F.when(_doc() % 3 == 0, "of it").when(_doc() % 3 == 1, "not there").otherwise("").alias("source_quote"), F.lit("").alias("target_quote"), F.lit("All of it").alias("evidence"), F.lit("Page").alias("target"), F.lit("append_existing").alias("operation"),
    )
    return validate.critic_issues(t, "evidence").select("doc_id", F.array_join("errors", ",").alias("errors"), "severity", "accepted")


_SEEDED = ("citrus", "green tea", "berries")


@query(f"""
WITH p AS (SELECT doc_id, 'On ' || {pick_sql(_SEEDED, 'doc_id')} || ' ' || lang AS title FROM documents)
SELECT doc_id::VARCHAR AS packet_id, CASE WHEN doc_id % 3 = 0 THEN 'en/Plants/Citrus/citrus.md' WHEN doc_id % 3 = 1 THEN 'en/Green Tea/green-tea.md' END AS path, 280 AS score FROM p WHERE doc_id % 3 < 2""")
def page_seeds(spark, d):
    """The category whose page is missing and whose name a packet asserts."""
    p = table(spark, d, "documents").select(_doc().cast("string").alias("packet_id"), F.concat(F.lit("On "), pick(_SEEDED, _doc()), F.lit(" "), "lang").alias("title"), F.lit("").alias("abstract"), F.lit("").alias("keywords"), F.lit("").alias("alert"))
    from .plans import normalize

    categories = spark.createDataFrame([("en/Plants/Citrus",), ("en/Green Tea",), ("en/Berries",), ("en/Chemicals",), ("en/Nothing",)], "category string")
    existing = spark.createDataFrame([("en/Berries/berries.md",)], "path string")
    return normalize.page_seeds(p, categories, existing, "en").select("packet_id", "path", "score")


@query()
def title_matches(spark, d):
    """The pages whose names are most like other pages' first words."""
    docs = table(spark, d, "documents")
    line = F.array_join(F.slice(F.split(text.key(F.get(F.split("text", "\n"), F.lit(0))), " "), 1, 4), " ")
    pages = docs.select(F.concat_ws("/", "lang", _doc().cast("string")).alias("path"), line.alias("title"), F.concat(F.lit("p"), _doc().cast("string")).alias("stem"))
    return catalog.title_matches(pages, table(spark, d, "benchmark").select(F.col("item_id").alias("title_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("wanted")))


_GENERIC = ", ".join(quoted(x) for x in catalog.GENERIC)
_STOP = ", ".join(quoted(x) for x in catalog.STOPWORDS)
_TIMES_SAID = lambda x, p: f"CASE WHEN {p} = '' OR {x} = '' THEN 0 ELSE len(regexp_extract_all({x}, '(?:^| )' || {p} || '(?:$| )')) END"
_NAMED_IN = lambda xs: f"list_filter({xs}, lambda p: p <> '' AND p NOT IN ({_GENERIC}) AND {_TIMES_SAID('every', 'p')} > 0)"


@query(f"""
WITH d AS (SELECT doc_id, lang, source, text, {_key("string_split(text, chr(10))[1]")} AS head, {_key('text')} AS body FROM documents WHERE lang = 'en' AND text IS NOT NULL),
g AS (SELECT *, 'en/' || coalesce(nullif(split_part(body, ' ', 3), ''), 'x') || '/' || doc_id || '.md' AS path, [split_part(body, ' ', 4), upper(split_part(body, ' ', 5)), source] AS tags, regexp_replace(array_to_string(string_split(head, ' ')[1:2], ' '), '^(?:the|what is|what are|an introduction to)\\s+', '') AS alias, regexp_replace(string_split(head, ' ')[1], '^(?:the|what is|what are|an introduction to)\\s+', '') AS stem FROM d),
n AS (SELECT *, list_filter(list_distinct([alias, stem]), lambda x: length(x) >= 4 AND x NOT IN ({_GENERIC})) AS names FROM g),
i AS (SELECT item_id, {_key("split_part(text, '. ', 1)")} AS t, {_key("split_part(text, '. ', 2)")} AS k, {_key('text')} AS a, {_key("repeat(split_part(text, '. ', 1) || ' ', 4)")} AS f FROM benchmark),
e AS (SELECT *, trim(regexp_replace(concat_ws(' ', t, k, a, f, ''), ' +', ' ', 'g')) AS every FROM i),
m AS (SELECT item_id, path, t, k, a, f, every, tags, body, list_filter(names, lambda x: {_TIMES_SAID('t', 'x')} + {_TIMES_SAID('k', 'x')} + {_TIMES_SAID('a', 'x')} + {_TIMES_SAID('f', 'x')} > 0) AS named FROM e JOIN n ON len(list_filter(names, lambda x: contains(' ' || every || ' ', ' ' || x || ' '))) > 0),
c AS (SELECT item_id, path, list_sort(named) AS named, {' + '.join(f"coalesce(list_sum(list_transform(named, lambda x: least({_TIMES_SAID(c, 'x')}, 3))), 0) * {w}" for c, w in (('t', 240), ('k', 180), ('a', 120), ('f', 25)))} AS said,
    least(len({_NAMED_IN(f"list_transform(tags, lambda p: {_key('p')})")}), 8) * 18.0 AS tagged, len(list_distinct({_NAMED_IN(f"[{_key("split_part(path, '/', 2)")}]")})) * 30.0 AS category,
    list_sort(list_filter(list_distinct(list_intersect(string_split(every, ' '), string_split(body, ' '))), lambda w: length(w) >= 5 AND w NOT IN ({_STOP}))) AS shared FROM m WHERE len(named) > 0),
s AS (SELECT *, round(said + tagged + category + least(len(shared), 20) * 1.5, 2) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lower(path), path) AS rank FROM s)
SELECT item_id AS packet_id, path, rank::INT AS rank, score::DOUBLE AS score, array_to_string(named, ',') AS named, array_to_string(shared[1:30], ',') AS matched_terms, tagged::DOUBLE AS tags, category::DOUBLE AS category, (least(len(shared), 20) * 1.5)::DOUBLE AS body FROM r WHERE rank <= 10""")
def ranked_retrieval(spark, d):
    """The ten pages (documents by their first words) that each packet (benchmark item) is most about, with the parts of the score."""
    body = text.key("text")
    word = lambda n: F.coalesce(F.get(F.split(body, " "), F.lit(n - 1)), F.lit(""))
    head = F.split(text.key(F.get(F.split("text", "\n"), F.lit(0))), " ")
    folder = F.when(word(3) == "", "x").otherwise(word(3))
    pages = table(spark, d, "documents").where("lang = 'en' AND text IS NOT NULL").select(F.concat_ws("/", F.lit("en"), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.array_join(F.slice(head, 1, 2), " ").alias("title"), F.get(head, F.lit(0)).alias("stem"), F.array(word(4), F.upper(word(5)), "source").alias("tags"), F.col("text").alias("body"))
    part = lambda n: F.coalesce(F.get(F.split("text", r"\. "), F.lit(n - 1)), F.lit(""))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("packet_id"), part(1).alias("title"), part(2).alias("keywords"), F.col("text").alias("abstract"), F.concat(F.repeat(F.concat(part(1), F.lit(" ")), 4), F.lit("\n# References\nnone of this counts")).alias("full_text"), F.lit("").alias("alert"))
    found = catalog.retrieve(pages, items, "en")
    component = lambda c: F.coalesce(F.try_element_at("score_components", F.lit(c)), F.lit(0.0)).alias(c)
    return found.select("packet_id", "path", "rank", "score", F.array_join("entity_matches", ",").alias("named"), F.array_join("matched_terms", ",").alias("matched_terms"), *map(component, ("tags", "category", "body")))
