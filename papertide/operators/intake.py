"""Triage of intake records, and the reads over articles, papers and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.classify import names_where
from ..functions.text import collapse, let, or_empty, or_null
from ..functions.values import STOPPED, TERMINAL

#: Words and their weights, in order.
POSITIVE = {"review": 3, "systematic review": 4, "meta-analysis": 4, "randomized": 2, "clinical": 2, "human": 2, "patients": 2, "therapy": 2, "treatment": 2, "disease": 2, "inflammation": 2, "oxidative stress": 2, "neuro": 2, "cancer": 2, "metabolic": 1, "cardio": 1, "immune": 1, "microbiome": 1, "gut": 1, "brain": 1, "healing": 2, "health": 1}
NEGATIVE = {"feed": -4, "broiler": -4, "poultry": -4, "cat food": -5, "dog food": -5, "pet food": -5, "aquaculture": -4, "fertilizer": -4, "crop": -3, "spinach": -3, "mustard plant": -4, "aphid": -5, "soil": -3, "agriculture": -3, "field trial": -2, "fish": -3, "livestock": -4}
SELECTED, REJECTED = 6, -3
#: States of a paper that take its articles out of the backlog.
STARTED = ("drafted", "committed", "pr_open", "merged")


def lexicon_hits(text: Column, lexicon: dict[str, int]) -> Column:
    """Structs of term and weight for each term that a lower-case text holds, in the lexicon's order."""
    if not lexicon:
        return F.array().cast("array<struct<term:string,weight:int>>")
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight")) for t, w in lexicon.items()])
    return let(F.lower(text), lambda low: F.filter(terms, lambda x: F.contains(low, x["term"])))


def triage(text: Column, authors: Column, lexicon: dict[str, int] | None = None) -> Column:
    """Struct of score, status and reasons, by terms and number of authors (null: unknown)."""
    hits = lexicon_hits(text, POSITIVE | NEGATIVE if lexicon is None else lexicon)
    bonus = F.when(authors >= 4, 2).when(authors >= 2, 1).when(authors == 1, -2).otherwise(0)
    return let(hits, lambda h: _scored(h, bonus, authors))


def _scored(hits: Column, bonus: Column, authors: Column) -> Column:
    score = F.aggregate(hits, F.lit(0), lambda a, x: a + x["weight"]) + bonus
    why = F.when(authors >= 4, "+2:multi-author").when(authors >= 2, "+1:team-authored").when(authors == 1, "-2:single-author")
    reasons = F.concat(F.transform(hits, lambda x: F.concat(F.when(x["weight"] > 0, "+").otherwise(""), x["weight"].cast("string"), F.lit(":"), x["term"])), F.array_compact(F.array(why)))
    return F.struct(score.alias("score"), status(score).alias("status"), reasons.alias("reasons"))


def status(score: Column) -> Column:
    return F.when(score >= SELECTED, "selected").when(score <= REJECTED, "rejected").otherwise("review")


def topic_hits(topic: str, fields: dict[str, Column]) -> Column:
    """Struct of hits and fields: 3 for a field with the whole topic, else one for each of its words."""
    topic = topic.lower()
    terms = topic.split()
    parts = []
    for name, x in fields.items():
        n = let(F.lower(or_empty(x)), lambda low: F.when(F.contains(low, F.lit(topic)), 3).otherwise(sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))))
        parts.append(F.struct(F.lit(name).alias("field"), n.alias("n")))
    found = F.filter(F.array(*parts), lambda x: x["n"] > 0)
    return F.struct(F.aggregate(found, F.lit(0), lambda a, x: a + x["n"]).alias("hits"), F.transform(found, lambda x: x["field"]).alias("fields"))


def ranked_by_topic(candidates: DataFrame, n: int) -> DataFrame:
    """Most hits first, then score, selected ones, alert and title."""
    return candidates.orderBy(F.desc("hits"), F.desc("score"), (F.col("status") != "selected"), F.lower("alert_name"), F.lower("title")).limit(n)


def conjunction(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions that are set."""
    for x in conditions:
        df = df if x is None else df.where(x)
    return df


def matches_any(columns: list[str], query: str) -> Column:
    """Whether any column holds the query, whatever the case; % and _ in it are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return out


def list_articles(articles: DataFrame, papers: DataFrame, status: str = "all", alert_name: str | None = None, min_score: int = 0, processed: bool | None = None, limit: int = 100) -> DataFrame:
    """Articles with their papers. min_score: 0 sets no bound, a negative one does, unlike in backlog(). processed: yes, no, or either."""
    filtered = conjunction(
        articles,
        None if status == "all" else F.col("status") == status,
        F.col("alert_name") == alert_name if alert_name else None,
        F.col("score") >= min_score if min_score else None,
        None if processed is None else F.col("processed_at").isNotNull() if processed else F.col("processed_at").isNull(),
    )
    return filtered.join(papers.drop("title"), "paper_key", "left").orderBy(F.desc("score"), F.asc_nulls_first("alert_name"), F.asc_nulls_first("rank_in_email"), "article_key").limit(limit)


def backlog(articles: DataFrame, papers: DataFrame, status: str = "selected", min_score: int = 0, source: str | None = None, open_access_only: bool = False, include_processed: bool = False, limit: int = 100) -> DataFrame:
    """Unprocessed articles, best first. The host filter comes before the limit, so it never returns too few."""
    filtered = conjunction(
        articles,
        None if status == "all" else F.col("status") == status,
        F.col("score") >= min_score if min_score > 0 else None,
        F.col("is_open_access") if open_access_only or source else None,
        ids.host_contains("article_url", source) if source else None,
        None if include_processed else F.col("processed_at").isNull(),
    )
    joined = filtered.join(papers.select("paper_key", "canonical_url", "doi", "pmid", "workflow_state"), "paper_key", "left")
    open_ = None if include_processed else ~F.coalesce("workflow_state", F.lit("discovered")).isin(*STARTED)
    return conjunction(joined, open_).orderBy(F.desc("score"), F.asc_nulls_first("alert_name"), F.desc_nulls_last("created_at"), "article_key").limit(limit)


def list_papers(papers: DataFrame, status: str = "all", workflow_state: str = "all", limit: int = 100) -> DataFrame:
    blank = {"matched": ("matched_content_path", True), "unmatched": ("matched_content_path", False), "archived": ("archived_source_path", True), "unarchived": ("archived_source_path", False)}
    test = None
    if status in blank:
        name, filled = blank[status]
        test = or_null(name).isNotNull() if filled else or_null(name).isNull()
    elif status != "all":
        raise ValueError(f"unknown status {status}")
    return conjunction(papers, test, None if workflow_state == "all" else F.col("workflow_state") == workflow_state).orderBy(F.desc_nulls_last("updated_at"), F.asc_nulls_first("title"), "paper_key").limit(limit)


def page_of(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A page of between 10 and 250 rows, with the number of all rows beside each: a top k and a count, neither of which gathers the rows."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(size, 10), 250)).withColumn("total", total)


def alert_summary(articles: DataFrame, by: str = "alert_name") -> DataFrame:
    """Counts by status, those with most selected ones first."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("selected", "review", "rejected", "invalid")]
    return articles.groupBy(by).agg(F.count("*").alias("article_count"), *counts).orderBy(F.desc("selected_count"), F.desc("article_count"), F.asc_nulls_first(by))


def alert_totals(articles: DataFrame, by: str = "alert_name") -> DataFrame:
    return articles.groupBy(by).agg(F.count("*").alias("article_count")).orderBy(F.asc_nulls_first(by))


def find_articles(articles: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(identifier): the article that has it as its key, else as article url or alternate url; of several the one of least key."""
    names = ("article_key", "article_url", "scholar_url")
    have = articles.select(F.col("article_key").alias("found"), F.explode(F.array(*[F.struct(F.lit(min(i, 1)).alias("kind"), F.col(c).cast("string").alias("identifier")) for i, c in enumerate(names)])).alias("x")).select("found", "x.*").where("identifier <> ''")
    first = probes.join(have, "identifier").groupBy("identifier").agg(F.min_by("found", F.struct("kind", "found")).alias("article_key"))
    return first.join(articles, "article_key")


def with_reasons(articles: DataFrame, column: str = "reasons_json") -> DataFrame:
    """The reasons of a score, stored as JSON, as an array; null where that is no list of texts."""
    return articles.withColumn("reasons", F.from_json(column, "array<string>")).drop(column)


def mail_query(base: str, extra: str = "", after: str | None = None, before: str | None = None) -> str:
    """A mailbox search: base and extra terms, from one day up to another."""
    terms = f"({base.strip()}) ({extra.strip()})" if extra.strip() else base if not extra else base.strip()
    return " ".join([f"({terms})", *[f"{name}:{day.replace('-', '/')}" for name, day in (("after", after), ("before", before)) if day]])

def sync_summary(messages: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of each alert, with the number of messages that had any text."""
    n = messages.agg(F.count_if(or_null("html").isNotNull())).scalar()
    per = articles.groupBy("alert_name").agg(F.count("*").alias("articles"), F.count_if(F.col("status") == "selected").alias("selected"), F.count_if(F.col("status") == "review").alias("review"))
    return per.withColumn("messages_with_html", n).orderBy(F.desc("articles"), F.lower("alert_name"))


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key. Spark takes the first of each key before the exchange as well, as only one is wanted."""
    at = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("__at", at).where("__at = 1").drop("__at")


def latest(df: DataFrame, key: str, order: Column, *columns: str) -> DataFrame:
    """Of each key the columns of its last row, by an aggregate that combines before the exchange."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("x")).select(key, "x.*")


def without_jobs(articles: DataFrame, jobs: DataFrame) -> DataFrame:
    """Articles that no job has by its key, article url or alternate url: OR as one hash join on tagged keys."""
    tag = lambda t, x: F.when(F.col(x).isNotNull(), F.struct(F.lit(t).alias("t"), F.col(x).cast("string").alias("v")))
    wanted = articles.select("article_key", F.explode(F.array_compact(F.array(tag("key", "article_key"), tag("url", "article_url"), tag("url", "scholar_url")))).alias("k"))
    have = jobs.select(F.explode(F.array_compact(F.array(tag("key", "article_key"), tag("url", "source_url")))).alias("k"))
    taken = wanted.join(have, "k", "left_semi").select("article_key")
    return articles.join(taken, "article_key", "left_anti")


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("state").isin(*TERMINAL))


def resolve_papers(papers: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(identifier): the paper that has it as key, canonical url, DOI or registry number, in this order; blanks never match."""
    x = F.trim(F.col("identifier"))
    wanted = probes.select("identifier", F.explode(F.map_from_arrays(F.array(*map(F.lit, (0, 1, 2, 3))), F.array(x, ids.canonical_url(x), ids.doi(x), F.when(x.rlike(r"^\d+$"), x).otherwise("")))).alias("kind", "value")).where("value <> ''")
    have = papers.select("paper_key", F.explode(F.map_from_arrays(F.array(*map(F.lit, (0, 1, 2, 3))), F.array("paper_key", or_empty("canonical_url"), or_empty("doi"), or_empty("pmid")))).alias("kind", "value")).where("value <> ''")
    return wanted.join(have, ["kind", "value"]).groupBy("identifier").agg(F.min_by("paper_key", F.struct("kind", "paper_key")).alias("paper_key"))


def resolve_with_articles(papers: DataFrame, articles: DataFrame, probes: DataFrame) -> DataFrame:
    """resolve_papers(); what it doesn't know, by the paper of an article that has it as article url or alternate url."""
    own = resolve_papers(papers, probes)
    urls = articles.where(F.col("paper_key").isNotNull()).select("paper_key", F.explode(F.array_compact(F.array(or_null("article_url"), or_null("scholar_url")))).alias("identifier"))
    other = probes.join(own, "identifier", "left_anti").join(urls, "identifier").join(papers.select("paper_key"), "paper_key", "left_semi")
    return own.unionByName(other.groupBy("identifier").agg(F.min("paper_key").alias("paper_key")))


def with_faults(articles: DataFrame) -> DataFrame:
    """Articles with `faults`: what would be refused. Rows with any are kept apart instead of stopping a load."""
    blank = lambda c: F.trim(or_empty(c)) == ""
    domain = F.trim(or_empty("domain"))
    tests = {"missing_key": blank("article_key"), "unknown_status": ~F.coalesce(F.col("status").isin("selected", "review", "rejected", "invalid"), F.lit(False)), "invalid_domain": domain.isin("", ".", "..") | F.contains(domain, F.lit("/")) | F.contains(domain, F.lit("\\")), "no_source": blank("article_url") & blank("scholar_url")}
    return articles.withColumn("faults", names_where(tests))


def parse_candidates(messages: DataFrame, parse) -> DataFrame:
    """A row for each candidate of a message; parse gives an array of structs from html and subject."""
    rows = messages.withColumn("c", parse(F.col("html"), F.col("subject"))).select("message_id", F.posexplode("c").alias("pos", "c")).select("message_id", (F.col("pos") + 1).alias("rank_in_email"), "c.*")
    text = F.concat_ws(" ", *[or_null(c) for c in ("alert_name", "title", "publication_info", "snippet")])
    return rows.withColumn("t", triage(text, F.col("author_count"))).select("*", "t.*").drop("t")


def with_identity(candidates: DataFrame) -> DataFrame:
    return candidates.withColumns({"article_key": ids.article_key("alert_name", "title", "article_url"), "paper_key": ids.paper_key("title", "article_url"), "canonical_url": ids.canonical_url("article_url"), "doi": ids.doi("article_url"), "pmid": ids.pmid("article_url"), "is_open_access": ids.host_in("article_url")})


def check_domain(value: str) -> str:
    """One name of a top folder; raises before anything is read."""
    value = " ".join(value.split())
    if not value or value in (".", "..") or "/" in value or "\\" in value:
        raise ValueError("domain must be one top-level content directory name")
    return value


def stopped(state: Column) -> Column:
    return state.isin(*STOPPED)


def normalized_alert(x: Column) -> Column:
    return F.regexp_replace(collapse(F.replace(x, F.lit("- new results"), F.lit(""))), r"^\[|\]$", "")


def mail_queries(base: Column, extra: Column, after: Column, before: Column) -> Column:
    """mail_query() of columns; days are dates or their texts."""
    extra = F.coalesce(extra, F.lit(""))
    terms = F.when(F.trim(extra) != "", F.concat(F.lit("("), F.trim(base), F.lit(") ("), F.trim(extra), F.lit(")"))).when(extra == "", base).otherwise(F.trim(base))
    day = lambda name, x: F.when(F.coalesce(x.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}:"), F.replace(x.cast("string"), F.lit("-"), F.lit("/"))))
    return F.concat_ws(" ", F.concat(F.lit("("), terms, F.lit(")")), day("after", after), day("before", before))


def curated(candidates: DataFrame, topic: str, most: int, fields: tuple[str, ...] = ("title", "snippet", "publication_info", "authors", "alert_name")) -> DataFrame:
    """candidates(alert_name, title, article_url, score, status and fields) of a topic, best first, with hits, matched_fields and identity; without a topic those that were selected."""
    if topic.strip():
        found = candidates.withColumn("__t", topic_hits(topic, {f: F.col(f) for f in fields if f in candidates.columns}))
        rows = found.select(candidates.columns + ["__t.hits", F.col("__t.fields").alias("matched_fields")]).where("hits > 0")
    else:
        rows = candidates.where("status = 'selected'").withColumns({"hits": F.lit(0), "matched_fields": F.array().cast("array<string>")})
    # the rows that are left are few, and only they get their identity
    return with_identity(ranked_by_topic(rows, most))
