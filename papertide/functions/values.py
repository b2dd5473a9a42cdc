"""Dates, numbers, lists and JSON; ranks of workflow states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c, collapse, or_empty, or_null

#: Fixed values.
WORKFLOW = ("discovered", "scraped", "matched", "drafted", "committed", "pr_open", "merged")
WORKFLOW_TIMES = {"scraped": "scraped_at", "matched": "matched_at", "drafted": "drafted_at", "committed": "committed_at", "pr_open": "pr_opened_at", "merged": "merged_at"}
JOB_STATES = ("queued", "leased", "scraping", "matching", "drafting", "validating", "validated", "needs_review", "publishing", "pr_open", "duplicate", "rejected", "retry", "failed")
TERMINAL = ("pr_open", "duplicate", "rejected", "failed")
STOPPED = (*TERMINAL, "needs_review", "validated")
BACKOFF_SECONDS, BACKOFF_MOST = 300, 21_600
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def iso_second(ts: Column | str) -> Column:
    return F.date_format(c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def in_window(ts: Column | str, today: Column, days_back: int = 3, after: str | None = None, before: str | None = None) -> Column:
    """From `after`, or so many days before today, up to but without `before`."""
    start = F.lit(after).cast("date") if after else F.date_sub(today, days_back)
    out = c(ts) >= start
    return out & (c(ts) < F.lit(before).cast("date")) if before else out


def partial_date(x: Column | str) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from dates written with - or /; other text is kept, collapsed."""
    x = collapse(or_empty(x))
    pattern = r"^(\d{4})(?:[-/](\d{1,2}))?(?:[-/](\d{1,2}))?(?:[T ].*)?$"
    part = lambda i: F.regexp_extract(x, pattern, i)
    whole = F.concat_ws("-", part(1), F.when(part(2) != "", F.lpad(part(2), 2, "0")), F.when(part(3) != "", F.lpad(part(3), 2, "0")))
    return F.when(part(1) != "", whole).otherwise(x)


def date_from_parts(parts: Column) -> Column:
    """[year, month, day], as many as there are; null without a year."""
    year, month, day = (F.get(parts, i) for i in range(3))
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(year.isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.when(month.isNotNull(), pad(month)), F.when(month.isNotNull() & day.isNotNull(), pad(day))))


def count_authors(x: Column | str) -> Column:
    """Parts between commas, else around the word and, else one; null if blank."""
    x = F.regexp_replace(c(x), "…", "")
    parts = lambda p: F.size(F.filter(F.split(x, p), lambda s: F.trim(s) != ""))
    return F.when(or_null(x).isNull(), None).when(x.contains(","), parts(",")).when(F.lower(x).contains(" and "), parts(r"(?i)\band\b")).otherwise(1)


def backoff_seconds(attempts: Column | str) -> Column:
    """Doubling from BACKOFF_SECONDS, up to BACKOFF_MOST."""
    n = F.least(F.greatest(c(attempts) - 1, F.lit(0)), F.lit(30))
    return F.least(F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2), n), F.lit(BACKOFF_MOST)).cast("long")


def parse_int(x: Column | str, default: int, least: int | None = None, most: int | None = None) -> Column:
    out = F.coalesce(F.expr(f"try_cast(`{x}` AS int)") if isinstance(x, str) else x.try_cast("int"), F.lit(default))
    out = out if least is None else F.greatest(F.lit(least), out)
    return out if most is None else F.least(F.lit(most), out)


def workflow_rank(state: Column | str) -> Column:
    """Place in the order of states; unknown and null ones count as the first."""
    at = F.array_position(F.array(*map(F.lit, WORKFLOW)), F.trim(or_empty(state)))
    return F.greatest(at - 1, F.lit(0)).cast("int")


def derived_state(state: Column | str, content_path: Column | str, commit: Column | str, pr: Column | str) -> Column:
    """The state that the evidence shows at least: pr, else commit, else path; never below the one given."""
    asked = F.coalesce(or_null(F.trim(or_empty(state))), F.lit("discovered"))
    rank = workflow_rank(asked)
    out = asked
    for evidence, shown in ((content_path, "matched"), (commit, "committed"), (pr, "pr_open")):
        out = F.when((or_empty(evidence) != "") & (rank < WORKFLOW.index(shown)), F.lit(shown)).otherwise(out)
    return out


def json_object(x: Column | str) -> Column:
    """The JSON object in a text that may fence it or talk around it; null if it doesn't parse."""
    x = F.regexp_replace(F.trim(or_empty(x)), r"(?s)^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def as_list(x: Column | str) -> Column:
    """A list stays, a blank string is empty, another string is a list of one."""
    return F.when(or_null(F.trim(c(x))).isNull(), F.array().cast("array<string>")).otherwise(F.array(F.trim(c(x))))


def best(values: Column, order) -> Column:
    """The first of the values for which order is greatest."""
    ranked = F.transform(values, lambda v, i: F.struct(order(v).alias("o"), (-i).alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]


def choose_complete(values: Column, most: int) -> Column:
    """The longest text that fits and isn't cut off, else the longest; the first of equals; empty without any."""
    found = F.filter(F.transform(values, collapse), lambda v: (v != "") & (F.length(v) <= most))
    complete = lambda v: ~(v.endswith("...") | v.endswith("…"))
    return F.coalesce(best(found, lambda v: F.struct(complete(v), F.length(v))), F.lit(""))
