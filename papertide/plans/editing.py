"""Edits of Markdown pages: a block under a heading, references by number, rendered changes checked."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classify
from ..functions.text import bullet_sentences, key, let, or_empty, or_null, strip

_FOOTNOTE = re.compile(r"\[\^\d+\]:")
MOST_ADDED = 160


def _level(line: str) -> int:
    found = re.match(r"(#{1,6})\s", line)
    return len(found[1]) if found else 0


def _end_of_section(lines: list[str], start: int, level: int) -> int:
    """The first line after start that opens a section of that level or a higher one, or the footnotes."""
    return next((i for i in range(start, len(lines)) if 0 < _level(lines[i]) <= level or _FOOTNOTE.match(lines[i])), len(lines))


def insert_block(page: str, heading: str, parent: str, block: str) -> str:
    """The block at the end of the heading's section. A heading that isn't there is made: at the end if of level 2, else below its parent."""
    lines, new = page.splitlines(), block.splitlines()
    places = {x.strip(): i for i, x in reversed(list(enumerate(lines)))}
    if heading in places:
        at = _end_of_section(lines, places[heading] + 1, _level(heading))
    else:
        new = [heading, "", *new]
        if parent:
            if parent not in places:
                raise ValueError(f"no such parent heading: {parent}")
            if _level(heading) != _level(parent) + 1:
                raise ValueError("a new heading must be one level below its parent")
            at = _end_of_section(lines, places[parent] + 1, _level(parent))
        elif _level(heading) == 2:
            at = next((i for i, x in enumerate(lines) if _FOOTNOTE.match(x)), len(lines))
        else:
            raise ValueError(f"no such heading and no parent: {heading}")
    gap = [""] if at and lines[at - 1].strip() else []
    return "\n".join([*lines[:at], *gap, *new, "", *lines[at:]]).rstrip() + "\n"


@F.pandas_udf(T.StructType([T.StructField("page", T.StringType()), T.StructField("error", T.StringType())]))
def inserted(page: pd.Series, heading: pd.Series, parent: pd.Series, block: pd.Series) -> pd.DataFrame:
    """Columns form of insert_block: the page, or why it couldn't be changed."""
    out = []
    for args in zip(page, heading, parent, block, strict=True):
        try:
            out.append((insert_block(*[x or "" for x in args]), None))
        except ValueError as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["page", "error"])


#: A footnote from its start to the next one's, or to the end of the page.
_BLOCK = r"(?ms)^\[\^(\d+)\]:(.*?)(?=^\[\^\d+\]:|\z)"


def footnotes(page: Column) -> Column:
    """Array of structs of number and text, whole footnotes, in order."""
    part = lambda i: F.regexp_extract_all(or_empty(page), F.lit(_BLOCK), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("number"), part(2).alias("text")), lambda x: F.struct(x["number"].cast("int").alias("number"), x["text"].alias("text")))


def shared_reference(page: Column, doi: Column, url: Column) -> Column:
    """The number of the page's first footnote that holds the DOI, or the url if there is no DOI; else the next free number."""
    doi, url = F.lower(strip(or_empty(doi))), F.regexp_replace(F.lower(strip(or_empty(url))), "/+$", "")
    sought = F.when(doi != "", doi).otherwise(url)

    def of(found: Column) -> Column:
        hit = F.get(F.filter(found, lambda x: (sought != "") & F.contains(F.lower(x["text"]), sought)), F.lit(0))
        return F.coalesce(hit["number"], F.array_max(F.transform(found, lambda x: x["number"])) + 1, F.lit(1))

    return let(footnotes(page), of)


def bullet_block(bullets: Column, number: Column) -> Column:
    """Bullets by subsection, in the order in which subsections first come, each with its reference."""
    titles = F.array_distinct(F.transform(bullets, lambda b: b["subsection"]))
    of = lambda t: F.transform(F.filter(bullets, lambda b: b["subsection"] == t), lambda b: F.concat(F.lit("- "), b["text"], F.lit("[^"), number.cast("string"), F.lit("]")))
    return F.array_join(F.transform(titles, lambda t: F.concat(F.when(t != "", F.concat(F.lit("### "), t, F.lit("\n\n"))).otherwise(""), F.array_join(of(t), "\n"))), "\n\n")


def clean_title(title: Column, registry_title: Column, suffix: str = r"\s+[|–-]\s+(?:[A-Z][\w.&]*\s*){1,5}$") -> Column:
    """Without a publisher's name at the end; the registry's spelling if it is the same title."""
    text = F.trim(F.regexp_replace(or_empty(title), r"\s+", " "))
    bare = F.trim(F.regexp_replace(text, suffix, ""))
    bare = F.when(bare == "", text).otherwise(bare)
    same = (or_empty(registry_title) != "") & (key(or_empty(registry_title)) == key(bare))
    return F.when(same, registry_title).when(bare != "", bare).otherwise("Untitled Source")


def inline(x: Column) -> Column:
    """Text for a comment: on one line, without angle brackets."""
    return F.replace(F.replace(F.trim(F.regexp_replace(or_empty(x), r"\s+", " ")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def provenance(kind: Column, section: Column, quote: Column, cited: Column | None = None) -> Column:
    """Where a bullet comes from, as a comment below it."""
    said = [F.concat(F.lit("claim_kind: "), inline(F.coalesce(or_null(kind), F.lit("source_finding")))), F.concat(F.lit("source_section: "), inline(section)), F.concat(F.lit("source_quote: "), inline(quote))]
    none = F.array().cast("array<string>") if cited is None else F.coalesce(cited, F.array().cast("array<string>"))
    listed = F.when(F.size(none) > 0, F.array_join(F.transform(none, lambda c: inline(c)), "; ")).otherwise("none")
    return F.concat(F.lit("  <!-- provenance | "), F.concat_ws(" | ", *said, F.concat(F.lit("cited_references: "), listed)), F.lit(" -->"))


def with_findings(bullets: DataFrame, findings: DataFrame) -> DataFrame:
    """bullets(plan_id, bullet, text), findings(plan_id, bullet_index, code, severity, explanation): the bullets with `notes`, the comments on each that ask for attention; those on no bullet of the plan stand at bullet null."""
    asked = findings.where(F.col("severity").isin("review", "blocking")).select("plan_id", F.col("bullet_index").alias("bullet"), annotation(F.col("code"), F.col("severity"), F.col("explanation")).alias("note"))
    known = bullets.select("plan_id", "bullet", F.lit(True).alias("known"))
    placed = asked.join(known, ["plan_id", "bullet"], "left").withColumn("bullet", F.when(F.col("known"), F.col("bullet")))
    notes = placed.groupBy("plan_id", "bullet").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    same = (F.col("b.plan_id") == F.col("n.plan_id")) & F.col("b.bullet").eqNullSafe(F.col("n.bullet"))
    out = bullets.alias("b").join(notes.alias("n"), same, "full")
    return out.select(F.coalesce("b.plan_id", "n.plan_id").alias("plan_id"), "b.bullet", "b.text", F.coalesce("n.notes", F.array().cast("array<string>")).alias("notes"))


def apply_target(plans: DataFrame) -> DataFrame:
    """plans(plan_id, page, heading, parent_heading, doi, url, footnote, bullets of structs with text, subsection and comments): the page with the bullets under the heading and one footnote for the source, used again where it is there; or why not."""
    plans = plans.withColumn("number", shared_reference(F.col("page"), F.col("doi"), F.col("url")))
    # a plan has few bullets; grouped by sub-section in the order in which those first come
    b = plans.select("plan_id", "number", F.posexplode("bullets").alias("pos", "b")).select("plan_id", "number", "pos", "b.*")
    notes = F.array_join(F.coalesce("comments", F.array().cast("array<string>")), "\n")
    line = F.concat(F.lit("- "), "text", F.lit("[^"), F.col("number").cast("string"), F.lit("]"), F.when(notes != "", F.concat(F.lit("\n"), notes)).otherwise(""))
    title = F.when(or_empty("subsection") != "", F.concat(F.lit("### "), "subsection", F.lit("\n\n"))).otherwise("")
    parts = b.groupBy("plan_id", "subsection").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    parts = parts.select("plan_id", F.struct("pos", F.concat(title, F.array_join("x.line", "\n")).alias("part")).alias("p"))
    blocks = parts.groupBy("plan_id").agg(F.sort_array(F.collect_list("p")).alias("y")).select("plan_id", F.array_join("y.part", "\n\n").alias("block"))
    df = plans.join(blocks, "plan_id")
    df = df.select("plan_id", "number", "footnote", inserted(F.col("page"), or_empty("heading"), or_empty("parent_heading"), F.col("block")).alias("x"))
    has = F.contains(or_empty("x.page"), F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]:")))
    note = F.concat(F.regexp_replace("x.page", r"\n+$", ""), F.lit("\n\n"), F.replace("footnote", F.lit("#"), F.col("number").cast("string")), F.lit("\n"))
    return df.select("plan_id", "number", F.when(has, F.col("x.page")).otherwise(note).alias("page"), F.col("x.error").alias("error"))


def annotation(code: Column, severity: Column, explanation: Column) -> Column:
    """A review's finding as a comment in the page."""
    return F.concat(F.lit("  <!-- review "), severity, F.lit(" "), code, F.lit(": "), F.replace(explanation, F.lit("--"), F.lit("- -")), F.lit(" -->"))


def finding_comment(severity: Column, code: Column, explanation: Column, quote: Column | None = None) -> Column:
    """A review's finding as a comment in the form that stays with a bullet: its fields on one line."""
    field = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    said = [field("severity", F.coalesce(or_null(inline(severity)), F.lit("review"))), field("code", F.coalesce(or_null(inline(code)), F.lit("unknown_issue"))), field("explanation", inline(explanation))]
    quoted = [] if quote is None else [F.when(inline(quote) != "", field("source_quote", inline(quote)))]
    return F.concat(F.lit("  <!-- critic | "), F.concat_ws(" | ", *said, *quoted), F.lit(" -->"))


def section_lines(page: Column, heading: Column) -> Column:
    """The lines below a heading, up to one of its level or a higher one, or to the footnotes."""
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    none = F.array().cast("array<string>")

    def of(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, F.trim), F.trim(heading)).cast("int")
        rest = F.slice(lines, start + 1, F.size(lines))
        stops = lambda x: ((level(x) > 0) & (level(x) <= level(heading))) | F.regexp_like(x, F.lit(r"^\[\^\d+\]:"))
        end = F.array_position(F.transform(rest, stops), True).cast("int")
        return F.when(start == 0, none).when(end == 0, rest).otherwise(F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0))))

    return let(F.split(or_empty(page), "\n"), of)


def structure_issues(section: Column, bullets: Column, summary: Column, prefix: Column) -> Column:
    """Codes for a section that is grouped by property: bullets outside of a sub-section or of several ideas, a summary (null: none) that isn't above the sub-sections, bullets on animal work without their species."""
    first = F.array_position(F.transform(section, lambda x: F.startswith(x, F.lit("### "))), True)
    is_bullet = lambda x: F.startswith(x, F.lit("- "))
    outside = F.size(F.filter(section, lambda x, i: is_bullet(x) & ((first == 0) | (i + 1 < first)))) > 0
    bare = lambda x: F.trim(F.regexp_replace(F.substring(x, 3, 1 << 30), r"\[\^\d+\]$", ""))
    unscoped = lambda x: F.when((prefix != "") & F.startswith(F.lower(x), F.lower(prefix)), F.substring(x, F.length(prefix) + 1, F.length(x))).otherwise(x)
    several = F.exists(F.filter(section, is_bullet), lambda x: F.size(bullet_sentences(unscoped(bare(x)))) > 1)
    at = F.array_position(F.transform(section, lambda x: F.contains(x, F.trim(summary)) & ~F.contains(x, F.lit("<!--"))), True)
    misplaced = summary.isNotNull() & ((F.trim(summary) == "") | (at == 0) | ((first > 0) & (at > first)))
    unnamed = F.exists(bullets, lambda b: b["animal"] & F.exists(b["texts"], lambda t: ~classify.has_species(t)))
    tests = {"bullet_outside_property_subsection": outside, "bullet_not_single_idea": several, "section_summary_missing_or_misplaced": misplaced, "animal_bullet_missing_species_scope": unnamed}
    return classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})


def page_issues(before: Column, after: Column, doi: Column, url: Column, bullets: Column, heading: Column, grouped: Column, summary: Column | None = None, notes: Column | None = None, prefix: Column | None = None) -> Column:
    """All that is wrong with a changed page, sorted: front matter, footnote, each bullet's citation, provenance and findings, the summary, the structure, links to nowhere, size.

    bullets: an array of structs of texts (as rendered, an idea each), comment (its provenance), animal, notes (comments on it). summary: a struct of text and comment, or null. notes: comments on the whole target.
    """
    number = shared_reference(before, doi, url)
    mark = F.concat(F.lit("[^"), number.cast("string"), F.lit("]"))
    none = F.array().cast("array<string>")
    absent = lambda x: ~F.contains(after, x)
    whole = rendered_issues(before, after, number, doi, url, none)
    # these say which one is meant
    whole = F.filter(whole, lambda x: ~x.isin("reference_missing", "dead_anchor_link"))
    reference = F.array_compact(F.array(F.when(absent(F.concat(mark, F.lit(":"))), F.concat(F.lit("reference_"), number.cast("string"), F.lit("_missing")))))

    def of_bullet(b: Column, i: Column) -> Column:
        named = lambda test, what: F.when(F.coalesce(test, F.lit(False)), F.concat(F.lit("bullet_"), i.cast("string"), F.lit(f"_{what}")))
        return F.array_compact(F.array(named(F.exists(b["texts"], lambda t: absent(F.concat(F.lit("- "), t, mark))), "citation_missing"), named(absent(b["comment"]), "provenance_missing"), named(F.exists(b["notes"], absent), "critic_annotation_missing")))

    found = [whole, reference, F.flatten(F.transform(bullets, of_bullet)), F.transform(dead_links(after), lambda x: F.concat(F.lit("dead_anchor_link_"), x))]
    if summary is not None:
        cited = summary.isNotNull() & absent(F.concat(F.trim(summary["text"]), mark))
        told = summary.isNotNull() & absent(F.ltrim(summary["comment"]))
        found.append(F.array_compact(F.array(F.when(cited, "section_summary_citation_missing"), F.when(told, "section_summary_provenance_missing"))))
    if notes is not None:
        found.append(F.array_compact(F.array(F.when(F.exists(F.coalesce(notes, none), lambda x: absent(F.ltrim(x))), "target_critic_annotation_missing"))))
    text = F.lit(None).cast("string") if summary is None else summary["text"]
    found.append(F.when(grouped, structure_issues(section_lines(after, heading), bullets, text, F.lit("") if prefix is None else prefix)).otherwise(none))
    return F.array_sort(F.array_distinct(F.concat(*found)))


def dead_links(page: Column) -> Column:
    """Fragments that a page links to and doesn't have: no heading's slug and no id."""
    visible = F.regexp_replace(or_empty(page), r"(?s)<!--.*?-->", "")
    links = F.regexp_extract_all(visible, F.lit(r"\]\(#([^)]+)\)"), F.lit(1))
    slugs = F.transform(F.regexp_extract_all(or_empty(page), F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1)), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"[^a-z0-9 \-]", ""), " +", "-"))
    return F.array_except(links, F.concat(slugs, F.regexp_extract_all(or_empty(page), F.lit("id=[\"']([^\"']+)[\"']"), F.lit(1))))


def rendered_issues(before: Column, after: Column, number: Column, doi: Column, url: Column, bullets: Column) -> Column:
    """What is wrong with a changed page: front matter, reference, citations, size, links to nowhere."""
    front = lambda x: F.regexp_extract(or_empty(x), r"(?s)^---\n.*?\n---\n?", 0)
    lines = lambda x: F.size(F.split(or_empty(x), "\n"))
    mark = F.concat(F.lit("[^"), number.cast("string"), F.lit("]"))
    blocks = F.transform(footnotes(after), lambda x: x["text"])
    links = F.regexp_extract_all(or_empty(after), F.lit(r"\]\(#([^)]+)\)"), F.lit(1))
    slugs = F.transform(F.regexp_extract_all(or_empty(after), F.lit(r"(?m)^#{1,6}\s+(.+?)\s*$"), F.lit(1)), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"[^a-z0-9 \-]", ""), " +", "-"))
    anchors = F.concat(slugs, F.regexp_extract_all(or_empty(after), F.lit("id=[\"']([^\"']+)[\"']"), F.lit(1)))
    tests = {
        "frontmatter_changed": front(before) != front(after),
        "reference_missing": ~F.contains(after, F.concat(mark, F.lit(":"))),
        "duplicate_source_footnote": (or_empty(doi) != "") & (F.size(F.filter(blocks, lambda b: F.contains(F.lower(b), F.lower(doi)))) > 1),
        "doi_missing_from_reference": (or_empty(doi) != "") & ~F.contains(after, doi),
        "source_url_missing_from_reference": (or_empty(url) != "") & ~F.contains(after, url),
        "bullet_citation_missing": F.exists(bullets, lambda b: ~F.contains(after, F.concat(F.lit("- "), b, mark))),
        "dead_anchor_link": F.size(F.array_except(links, anchors)) > 0,
        "change_scope_too_large": lines(after) - lines(before) > MOST_ADDED,
    }
    return F.array_sort(classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}))
