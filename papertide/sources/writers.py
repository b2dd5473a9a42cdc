"""Rendering and writing: references and packets as Markdown, envelopes as JSON, runs as partitions, versions kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_nonempty, or_empty, or_null


def citation_url(doi: Column, *urls: Column) -> Column:
    return F.coalesce(or_null(F.concat(F.lit("https://doi.org/"), or_null(doi))), *[or_null(u) for u in urls], F.lit(""))


def footnote(number: Column, title: Column, url: Column, authors: Column, journal: Column, date: Column, doi: Column, abstract: Column | None = None) -> Column:
    """A footnote definition with the lines that have something to say."""
    line = lambda name, x: F.when(or_empty(x) != "", F.concat(F.lit(f"    **{name}:** "), x))
    head = F.concat(F.lit("[^"), number.cast("string"), F.lit("]: **Title:** ["), or_empty(title), F.lit("]("), or_empty(url), F.lit(")"))
    more = [line("Authors", authors), line("Journal", journal), line("Date", date), line("DOI", doi)] + ([line("Abstract", abstract)] if abstract is not None else [])
    return F.array_join(F.array_compact(F.array(head, *more)), "  \n")


def reference_block(number: Column, abstracts: str = "full") -> Column:
    """A source's whole footnote, from columns title, doi, reference_url, url, journal, pub_date, study_type, authors, institutions, abstract, archives (an array of urls).

    abstracts: full, omit, or truncated to 500 characters at a word.
    """
    if abstracts not in ("full", "truncated", "omit"):
        raise ValueError(f"unknown mode {abstracts}")
    doi, own = F.trim(or_empty("doi")), F.coalesce(or_null("url"), F.lit(""))
    page = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(first_nonempty("reference_url", "url"))
    source = F.when(own != "", own).otherwise(page)
    text = F.trim(F.regexp_replace(or_empty("abstract"), r"(?U)\s+", " "))
    if abstracts == "truncated":
        head = F.regexp_replace(F.regexp_replace(F.substring(text, 1, 500), " [^ ]*$", ""), "[ ,;:.]+$", "")
        text = F.when(F.length(text) > 500, F.concat(head, F.lit(" […]"))).otherwise(text)
    link = lambda shown, to: F.concat(F.lit("["), shown, F.lit("]("), to, F.lit(")"))
    line = lambda name, x, test=None: F.when(F.lit(True) if test is None else test, F.concat(F.lit(f"**{name}:** "), x, F.lit("<br>")))
    labels = F.array(F.lit("archive"), F.lit("archive-mirror"))
    archives = F.coalesce("archives", F.array().cast("array<string>"))
    copies = F.array_join(F.transform(archives, lambda u, i: link(F.coalesce(F.get(labels, i), F.concat(F.lit("archive-"), (i + 1).cast("string"))), u)), ", ")
    lines = [
        F.concat(F.lit("[^"), number.cast("string"), F.lit("]: "), line("Title", link(first_nonempty("title", F.lit("Untitled Source")), page))),
        line("Publication", link(F.coalesce(or_null("journal"), F.lit("Source")), source)),
        line("Date", F.coalesce(or_null("pub_date"), F.lit("Unknown"))),
        line("Study Type", F.coalesce(or_null("study_type"), F.lit("Research Article"))),
        line("Author(s)", F.coalesce(or_null("authors"), F.lit("Unknown"))),
        line("Institution(s)", F.trim(or_empty("institutions")), F.trim(or_empty("institutions")) != ""),
        line("Abstract", text, (text != "") & F.lit(abstracts != "omit")),
        line("Copy", copies, F.size(archives) > 0),
        line("DOI", link(doi, F.concat(F.lit("https://doi.org/"), doi)), doi != ""),
        F.concat(F.lit("**Source URL:** "), link(source, source)),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _quoted(x: Column, default: str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(or_null(x), F.lit(default)), r"\s+", " "))
    return F.replace(text, F.lit("`"), F.lit("\\`"))


def finding_line(severity: Column, code: Column, bullet: Column, explanation: Column) -> Column:
    """A finding of a review as an item of a list."""
    where = F.when(bullet.isNotNull(), F.concat(F.lit(" (bullet "), bullet.cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("`"), _quoted(severity, "unknown_severity"), F.lit("` `"), _quoted(code, "unknown_issue"), F.lit("`"), where, F.lit(": "), _quoted(explanation, "No explanation supplied."))


def review_audit(issues: DataFrame, override_reason: str | None = None) -> DataFrame:
    """issues(review_id, n, kind, code, severity, bullet_index, explanation, errors): for each review its audit as Markdown, what counts apart from what was refused."""
    said = finding_line(F.col("severity"), F.col("code"), F.col("bullet_index"), F.col("explanation"))
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    shown = F.when(F.size(errors) > 0, F.array_join(F.transform(errors, lambda e: F.concat(F.lit("`"), _quoted(e, ""), F.lit("`"))), ", ")).otherwise("not specified")
    refused = F.concat(F.lit("- `"), "kind", F.lit("` "), said, F.lit(" Validation errors: "), shown, F.lit("."))
    rows = issues.select("review_id", F.struct("n", F.when(F.size(errors) == 0, F.concat(F.lit("- "), said)).alias("good"), F.when(F.size(errors) > 0, refused).alias("bad")).alias("x"))
    # a review has few issues
    per = rows.groupBy("review_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    listed = lambda c: F.coalesce(or_null(F.array_join(F.array_compact(F.col(f"x.{c}")), "\n")), F.lit("- None"))
    parts = [F.lit(f"**Critic rejection override applied after human review.**\n\nOverride reason: {' '.join(override_reason.split())}")] if override_reason else []
    parts += [F.concat(F.lit("### Validated critic findings\n\n"), listed("good")), F.concat(F.lit("### Rejected critic observations (non-blocking)\n\nThese observations failed critic-evidence validation and did not affect the publication gate decision.\n\n"), listed("bad"))]
    return per.select("review_id", F.array_join(F.array(*parts), "\n\n").alias("audit"))


def queue_records(articles: DataFrame, matches: DataFrame, generated: Column) -> DataFrame:
    """articles(article_key, …), matches(article_key, rank, path, score): a JSON line for each article with its matches, best first, for an append-only queue folder."""
    best = matches.groupBy("article_key").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "score"))).alias("matches"))
    df = articles.join(best, "article_key", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<rank:int,path:string,score:double>>")))
    return df.select("article_key", F.to_json(F.struct(F.date_format(generated, "yyyy-MM-dd HH:mm:ss'Z'").alias("generated_at"), *[F.col(f"`{c}`") for c in df.columns])).alias("record"))


def packet_markdown(df: DataFrame) -> Column:
    """A packet as a page: title, details, abstract, body."""
    details = [F.when(or_empty(c) != "", F.concat(F.lit(f"- {name}: "), F.col(c))) for name, c in (("Authors", "authors"), ("Journal", "journal"), ("Date", "pub_date"), ("DOI", "doi"), ("URL", "url"), ("Study type", "study_type")) if c in df.columns]
    section = lambda name, c: F.when(or_empty(c) != "", F.concat(F.lit(f"## {name}\n\n"), F.col(c)))
    return F.array_join(F.array_compact(F.array(F.concat(F.lit("# "), first_nonempty("title", F.lit("Untitled"))), F.array_join(F.array_compact(F.array(*details)), "\n"), section("Abstract", "abstract"), section("Content", "body_markdown"))), "\n\n")


def front_matter(values: Column) -> Column:
    """A map of front matter without empty entries."""
    return F.map_filter(values, lambda k, v: v.isNotNull() & (v != "") & (v != "[]"))


def envelope(result: Column, error: Column | None = None) -> Column:
    ok = error.isNull() if error is not None else F.lit(True)
    good = F.to_json(F.struct(F.lit(True).alias("ok"), result.alias("result")))
    return F.when(ok, good).otherwise(F.to_json(F.struct(F.lit(False).alias("ok"), (error if error is not None else F.lit(None)).alias("error"))))


def run_id(started: Column, title: Column, source: Column) -> Column:
    """Time, slug of the title and ten digits of the source's digest."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(or_empty(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.date_format(started, "yyyyMMdd'T'HHmmss'Z'"), F.substring(slug, 1, 48), F.substring(F.sha2(source.cast("binary"), 256), 1, 10))


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("run_date").parquet(path)


def kept_versions(versions: DataFrame, keep: int, by: str = "name", at: str = "written_at") -> DataFrame:
    """The newest versions of each table."""
    return versions.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(F.desc(at)))).where(F.col("n") <= keep).drop("n")
