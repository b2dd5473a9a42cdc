"""Merges of papers, articles and messages: pure functions from the current rows and the changes to the new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import or_empty, or_null
from ..functions.values import WORKFLOW, WORKFLOW_TIMES, derived_state, workflow_rank

Rule = Callable[[Column, Column], Column]


def source_wins(cur: Column, new: Column) -> Column:
    return F.coalesce(new, cur)


def nonblank_wins(cur: Column, new: Column) -> Column:
    return F.coalesce(or_null(new), cur)


def keep(cur: Column, new: Column) -> Column:
    return cur


def first_wins(cur: Column, new: Column) -> Column:
    return F.coalesce(cur, new)


def merge(current: DataFrame, changes: DataFrame, on: str, rules: dict[str, Rule], default: Rule = source_wins) -> DataFrame:
    """New rows are taken as they are; for known keys each column has its rule. changes must have one row for each key."""
    old, new = current.alias("old"), changes.alias("new")
    joined = old.join(new, F.col(f"old.{on}") == F.col(f"new.{on}"), "full")
    known, changed = F.col(f"old.{on}").isNotNull(), F.col(f"new.{on}").isNotNull()
    out = []
    for c in current.columns:
        o = F.col(f"old.{c}")
        if c == on:
            out.append(F.coalesce(o, F.col(f"new.{c}")).alias(c))
        elif c in changes.columns:
            n = F.col(f"new.{c}")
            out.append(F.when(known & changed, rules.get(c, default)(o, n)).when(known, o).otherwise(n).alias(c))
        else:
            out.append(o.alias(c))
    return joined.select(*out)


def last_change(changes: DataFrame, on: str, order: str) -> DataFrame:
    """One row for each key: the last one."""
    rest = [c for c in changes.columns if c != on]
    return changes.groupBy(on).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(on, "x.*")


#: What a merge does with each column; columns without a rule take the new value.
MESSAGE_RULES: dict[str, Rule] = {"thread_id": keep}
PAPER_RULES: dict[str, Rule] = {"title": nonblank_wins, "canonical_url": nonblank_wins, "doi": nonblank_wins, "pmid": nonblank_wins, "matched_content_path": nonblank_wins, "updated_at": source_wins}
ARTICLE_KEPT = ("title", "alert_name", "created_at", "domain", "processed_at")


def upsert_messages(current: DataFrame, changes: DataFrame) -> DataFrame:
    return merge(current, changes, "message_id", MESSAGE_RULES)


def upsert_papers(current: DataFrame, changes: DataFrame) -> DataFrame:
    return merge(current, changes, "paper_key", PAPER_RULES, keep)


def upsert_articles(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Parsed columns are refreshed, also a status that was set by hand."""
    return merge(current, changes, "article_key", {c: keep for c in ARTICLE_KEPT}, lambda cur, new: new)


def advance(papers: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes(paper_key, state, matched_content_path, commit, pr, archive_path): states only rise; each state's time is set once."""
    renamed = changes.select("paper_key", *[F.col(c).alias(f"__{c}") for c in ("state", "matched_content_path", "commit", "pr", "archive_path")])
    df = papers.join(renamed, "paper_key", "left")
    changed = F.col("__state").isNotNull() | (or_empty("__matched_content_path") != "") | (or_empty("__commit") != "") | (or_empty("__pr") != "") | (or_empty("__archive_path") != "")
    target = derived_state("__state", "__matched_content_path", "__commit", "__pr")
    rank = F.when(changed, F.greatest(workflow_rank(target), workflow_rank("workflow_state"))).otherwise(workflow_rank("workflow_state"))
    df = df.withColumns({"__changed": changed, "__rank": rank})
    name = F.element_at(F.array(*map(F.lit, WORKFLOW)), F.col("__rank") + 1)
    sets = {"workflow_state": F.when(F.col("__changed"), name).otherwise(F.col("workflow_state"))}
    for column, source in (("matched_content_path", "__matched_content_path"), ("published_commit", "__commit"), ("published_pr", "__pr"), ("archived_source_path", "__archive_path")):
        if column in papers.columns:
            sets[column] = F.coalesce(or_null(source), F.col(column))
    for column in ("workflow_state_updated_at", "updated_at"):
        if column in papers.columns:
            sets[column] = F.when(F.col("__changed"), now).otherwise(F.col(column))
    for state, column in WORKFLOW_TIMES.items():
        if column in papers.columns:
            sets[column] = F.coalesce(F.col(column), F.when(F.col("__changed") & (F.col("__rank") >= WORKFLOW.index(state)), now))
    if "archived_at" in papers.columns:
        sets["archived_at"] = F.coalesce(F.col("archived_at"), F.when(or_empty("__archive_path") != "", now))
    return df.withColumns(sets).select(papers.columns)


def mark_processed(articles: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """keys(article_key): processed_at is set once."""
    hit = keys.select("article_key").distinct().withColumn("__hit", F.lit(True))
    return articles.join(hit, "article_key", "left").withColumn("processed_at", F.coalesce("processed_at", F.when(F.col("__hit"), now))).select(articles.columns)


def mark_processed_by(articles: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """probes(identifier): articles whose paper, article url or alternate url it is; processed_at is set once."""
    names = ("paper_key", "article_url", "scholar_url")
    have = articles.select("article_key", F.explode(F.array_compact(F.array(*[or_null(F.col(c).cast("string")) for c in names]))).alias("identifier"))
    return mark_processed(articles, have.join(probes, "identifier", "left_semi"), now)


def backfill_keys(articles: DataFrame, status: str = "all", limit: int | None = None) -> DataFrame:
    """Articles without a paper that have a url, best first, with the identity that they would get. What apply_keys() needs; as it is, the preview."""
    df = articles.where(F.col("paper_key").isNull()).drop("paper_key")
    df = df if status == "all" else df.where(F.col("status") == status)
    df = df if limit is None else df.orderBy(F.desc("score"), F.asc_nulls_first("created_at"), "article_key").limit(max(limit, 0))
    df = df.withColumn("source_url", F.trim(F.coalesce(or_null("article_url"), or_null("scholar_url"), F.lit("")))).where("source_url <> ''")
    return df.select("article_key", ids.paper_key("title", "source_url").alias("paper_key"), ids.canonical_url("source_url").alias("canonical_url"), ids.doi("source_url").alias("doi"), ids.pmid("source_url").alias("pmid"), "title")


def apply_keys(articles: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Articles with the paper keys of backfill_keys()."""
    df = articles.join(found.select("article_key", F.col("paper_key").alias("__key")), "article_key", "left")
    return df.withColumns({"updated_at": F.when(F.col("__key").isNotNull(), now).otherwise(F.col("updated_at")), "paper_key": F.coalesce("paper_key", "__key")}).select(articles.columns)


def advance_paths(papers: DataFrame, records: DataFrame, state: str, now: Column) -> DataFrame:
    """records(path, paper_key, n): papers that paths stand for, the last record of a path counting, raised to a state."""
    last = records.groupBy("path").agg(F.max_by("paper_key", "n").alias("paper_key"))
    changes = last.groupBy("paper_key").agg(F.max("path").alias("matched_content_path"))
    none = F.lit(None).cast("string")
    return advance(papers, changes.select("paper_key", F.lit(state).alias("state"), "matched_content_path", none.alias("commit"), none.alias("pr"), none.alias("archive_path")), now)


def set_status(articles: DataFrame, keys: DataFrame, status: str, now: Column) -> DataFrame:
    if status not in ("selected", "review", "rejected", "invalid"):
        raise ValueError(f"unknown status {status}")
    hit = keys.select("article_key").distinct().withColumn("__hit", F.lit(True))
    sets = {"status": F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))}
    return articles.join(hit, "article_key", "left").withColumns(sets).select(articles.columns)


def append_log(log: Column, chunk: Column, most: int = 200_000) -> Column:
    return F.right(F.concat(or_empty(log), or_empty(chunk)), F.lit(most))


def log_tail(log: Column, offset: Column) -> Column:
    """Struct of what follows an offset, the next offset, and whether it started anew as the offset lay past the end."""
    n, reset = F.length(log), offset > F.length(log)
    start = F.when(reset | (offset < 0), 0).otherwise(offset)
    return F.struct(F.substring(log, start + 1, n).alias("chunk"), n.alias("next_offset"), reset.alias("reset"))


def turns_tail(turns: DataFrame, log: str, order: str, text: str, offset: Column) -> DataFrame:
    """log_tail() of logs that are kept as turns, joined by line feeds: log, chunk, next_offset, reset. offset: of the log, from its column.

    Only what follows the offset is put together: the turns before it count with their lengths.
    """
    of = W.partitionBy(log)
    # null turns say nothing and add no line
    rows = turns.where(F.col(text).isNotNull()).withColumn("__n", F.length(text).cast("long") + 1)
    rows = rows.withColumns({"__end": F.sum("__n").over(of.orderBy(order)) - 1, "__whole": F.sum("__n").over(of) - 1, "__offset": offset})
    rows = rows.withColumn("__reset", F.col("__offset") > F.col("__whole")).withColumn("__from", F.when(F.col("__reset") | (F.col("__offset") < 0), 0).otherwise(F.col("__offset")))
    start = F.col("__end") - F.col("__n") + 1
    # the turn in which the offset lies gives its rest, one before it none; the line feed behind a turn is at its end
    part = F.when(F.col("__from") <= start, F.col(text)).otherwise(F.substring(F.col(text), (F.col("__from") - start + 1).cast("int"), F.length(text)))
    kept = F.when(F.col("__from") <= F.col("__end"), F.struct(F.col(order).alias("o"), part.alias("t")))
    out = rows.groupBy(log).agg(F.sort_array(F.collect_list(kept)).alias("x"), F.max("__whole").alias("next_offset"), F.max("__reset").alias("reset"))
    return out.select(log, F.array_join(F.transform("x", lambda t: t["t"]), "\n").alias("chunk"), "next_offset", "reset")
