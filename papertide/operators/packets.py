"""Source packets: sections, context packing, sentence mining, evidence, survivorship of metadata, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, ids
from ..functions.text import collapse, has_phrase, key, or_empty, or_null, sentences, strip, strip_markup
from ..functions.values import best, date_from_parts
from . import survivorship
from .survivorship import PLACEHOLDERS

#: The order of section groups in a context and the characters of each, and of all.
BUDGETS = {"abstract": 7_000, "results": 25_000, "traditional": 5_000, "introduction": 10_000, "conclusion": 3_000, "discussion": 5_000}
TOTAL = 55_000
REFERENCES = r"(?im)^#{1,6}\s+(?:references|bibliography|works cited)\s*$"
_DOI_WHOLE = r"(?i)^10\.\d{4,9}/[-._;()/:a-z0-9]+$"


def headed_sections(df: DataFrame, id_col: str, body: Column) -> DataFrame:
    """id_col, pos, level, heading, text: a row for each Markdown heading before the references, with its text; without any, one Document."""
    claim = F.split(or_empty_column(body), REFERENCES, 2)[0]
    parts = F.filter(F.split(claim, r"(?m)(?=^#{1,6}\s+\S)"), lambda p: strip(p) != "")
    rows = df.select(id_col, F.posexplode(parts).alias("pos", "raw"))
    marks = F.regexp_extract("raw", r"^(#{1,6})\s+", 1)
    heading = F.trim(F.regexp_extract("raw", r"^#{1,6}\s+([^\n]+)", 1))
    only = F.count("*").over(W.partitionBy(id_col)) == 1
    named = F.when(marks != "", heading).when(only, "Document").otherwise("Document metadata")
    return rows.select(id_col, "pos", F.length(marks).alias("level"), named.alias("heading"), strip("raw").alias("text"))


def or_empty_column(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def grouped_sections(sections: DataFrame, id_col: str) -> DataFrame:
    """With the group of each section: its own, else the last one named before it since a heading of level 1 or 2."""
    own = classify.section_group(F.col("heading"))
    mark = F.when(own.isNotNull(), own).when(F.col("level") <= 2, F.lit(""))
    w = W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return sections.withColumn("group", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))


def pack(sections: DataFrame, id_col: str, budgets: dict[str, int] | None = None, total: int = TOTAL) -> DataFrame:
    """Sections in order of group and place until a group's characters or all are spent; the one that crosses is cut."""
    budgets = budgets or BUDGETS
    names = list(budgets)
    df = sections.where(F.col("group").isin(*names))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("group"))
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("group"))
    before = lambda *p: W.partitionBy(*p).orderBy("__rank", "pos").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({"__rank": rank, "__n": F.length("text")})
    spent = F.coalesce(F.sum("__n").over(before(id_col, "group")), F.lit(0))
    df = df.withColumn("__n", F.greatest(F.lit(0), F.least(F.col("__n"), cap - spent)))
    spent = F.coalesce(F.sum("__n").over(before(id_col)), F.lit(0))
    df = df.withColumn("kept_chars", F.greatest(F.lit(0), F.least(F.col("__n"), F.lit(total) - spent)))
    return df.where("kept_chars > 0").withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("kept_chars").cast("int"))).drop("__rank", "__n")


def pack_skipping(entries: Column, budget: int) -> Column:
    """Entries in order that fit into what is left; one that doesn't is left out and the next is tried."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        fits = acc["used"] + F.length(e) <= budget
        return F.struct(F.when(fits, acc["used"] + F.length(e)).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(e))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(entries, state, step)["kept"]


def merge_windows(windows: DataFrame, id_col: str, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals that overlap or touch as one."""
    order = W.partitionBy(id_col).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = windows.withColumn("__reach", reach).withColumn("__new", F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(id_col, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def hit_windows(df: DataFrame, id_col: str, text: Column, term: str, before: int = 1800, after: int = 3200) -> DataFrame:
    """id_col, start, end around each place of a term, from 0, inside the text."""
    parts = F.split(F.lower(text), F.lit(_quoted(term.lower())))
    lengths = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)) + len(term), F.lit(0)) + x).cast("int"))))
    rows = df.select(id_col, F.length(text).alias("__n"), F.explode(ends).alias("__at"))
    return rows.select(id_col, F.greatest(F.col("__at") - before, F.lit(0)).alias("start"), F.least(F.col("__at") + after, F.col("__n")).alias("end"))


def _quoted(term: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in term)


def mine_sentences(sections: DataFrame, id_col: str, least: int, most: int, keep: Column, limit: int, carry: str | None = None) -> DataFrame:
    """The first sentences of a document's sections that a test on `sentence` (and a carried column) keeps and whose length fits."""
    text = F.regexp_replace("text", r"^#{1,6}[^\n]*\n+", "")
    rows = sections.select(id_col, "pos", *([carry] if carry else []), F.posexplode(sentences(text)).alias("n", "sentence")).withColumn("sentence", strip("sentence"))
    fits = (F.length("sentence") >= least) & (F.length("sentence") <= most) & ~F.contains("sentence", F.lit("\n")) & ~F.regexp_like("sentence", F.lit(r"^[#|!\[]"))
    at = F.row_number().over(W.partitionBy(id_col).orderBy("pos", "n"))
    return rows.where(fits & keep).withColumn("rank", at).where(F.col("rank") <= limit).select(id_col, "rank", "sentence")


def quantitative_results(sections: DataFrame, id_col: str, limit: int = 12) -> DataFrame:
    return mine_sentences(sections.where(F.regexp_like(key(F.col("heading")), F.lit(r"\bresults?\b|\boutcomes?\b"))), id_col, 60, 420, classify.has_quantity(F.col("sentence")), limit)


#: What a sentence of each kind says, over normalized text.
AIM = r"\b(?:objective|aim|hypothes\w*)\b"
AIM_OF = r"\b(?:effect|improv\w*|attenuat\w*|investigat\w*|evaluat\w*|assess\w*)\b"
OUTCOME = r"\b(?:improv\w*|enhanc\w*|attenuat\w*|decreas\w*|increas\w*|efficacy|beneficial|potential|support\w*|associated|accumulat\w*)\b"
BACKGROUND = r"\b(?:traditional|ethnobotan\w*|folk|historical|nutri\w*|vitamin\w*|mineral\w*|fibers?|phytochemical\w*|flavonoid\w*|carotenoid\w*|pectin\w*|glyc\w*|insulin\w*|diabet\w*|metabolic|blood pressure|hypertension|cholesterol|lipid\w*|antioxidant|anti inflammatory|cardioprotective)\b"
OWN_STUDY = r"\b(?:attracted significant attention|present study|objective was|study evaluated|effects .* were also compared|environmentally friendly process|sensory properties|first the efficacy|second the membrane)\b"
_THESIS_SECTION = r"\b(?:introduction|background|objective|aim)\b"
_BACKGROUND_SECTION = r"\b(?:introduction|background|traditional|ethnobotan\w*|historical)\b"


def _says(x: Column, pattern: str) -> Column:
    return F.regexp_like(key(x), F.lit(pattern))


def theses(sections: DataFrame, id_col: str, limit: int = 4) -> DataFrame:
    """Sentences that state an aim, from sections that open a paper."""
    s = F.col("sentence")
    return mine_sentences(sections.where(_says(F.col("heading"), _THESIS_SECTION)), id_col, 100, 650, _says(s, AIM) & _says(s, AIM_OF), limit)


def core_results(abstracts: DataFrame, id_col: str, abstract: Column, entity: Column | None = None, limit: int = 10) -> DataFrame:
    """Sentences of an abstract that tell an outcome, of an entity if one is given."""
    s = F.col("sentence")
    keep = _says(s, OUTCOME) & ~classify.is_methods_statement(s)
    rows = abstracts.select(id_col, F.lit(0).alias("pos"), F.lit("Abstract").alias("heading"), abstract.alias("text"), (F.lit("") if entity is None else or_empty_column(entity)).alias("entity"))
    return _of_entity(rows, id_col, 55, 700, keep, limit)


def background_claims(sections: DataFrame, id_col: str, entity: Column | None = None, limit: int = 8) -> DataFrame:
    """Sentences on what is known of a subject, from opening sections, without those on the study itself."""
    s = F.col("sentence")
    keep = _says(s, BACKGROUND) & ~classify.is_methods_statement(s) & ~_says(s, OWN_STUDY)
    rows = sections.where(_says(F.col("heading"), _BACKGROUND_SECTION)).withColumn("entity", F.lit("") if entity is None else or_empty_column(entity))
    return _of_entity(rows, id_col, 55, 700, keep, limit)


def _of_entity(rows: DataFrame, id_col: str, least: int, most: int, keep: Column, limit: int) -> DataFrame:
    named = (F.col("entity") == "") | has_phrase(key(F.col("sentence")), key(F.col("entity")))
    return mine_sentences(rows, id_col, least, most, keep & named, limit, carry="entity")


def key_findings(abstract: Column, limit: int = 5) -> Column:
    """The first sentences of 30 characters or more that don't open as a label or a link to the one before."""
    opening = r"(?i)^(?:(?:this|the|we|our|in this|here|however|therefore|thus|hence|moreover|furthermore)\b|(?:background|introduction|methods?|results?|conclusions?|objectives?|aims?|purpose)[:.]?\s*$)"
    found = F.filter(F.transform(F.split(F.trim(or_empty_column(abstract)), r"(?<=[.!?])\s+"), lambda s: strip(s)), lambda s: (F.length(s) >= 30) & ~F.regexp_like(s, F.lit(opening)))
    return F.slice(found, 1, limit)


def evidence(title: Column, abstract: Column, body: Column) -> Column:
    return F.concat(or_empty_column(title), F.lit("\n\n"), or_empty_column(abstract), F.lit("\n\n"), or_empty_column(body))


def exact_passage(text: Column, passage: Column) -> Column:
    return (or_empty_column(passage) != "") & F.contains(text, passage)


def spaced_passage(text: Column, passage: Column) -> Column:
    """Whether a text holds a passage if white space is taken alike."""
    return exact_passage(text, passage) | ((collapse(or_empty_column(passage)) != "") & F.contains(collapse(text), collapse(passage)))


def choose_abstract(groups: list[Column], least: int = 120) -> Column:
    """The longest whole abstract of the first group that has one, else the longest of the first group with any."""
    clean = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda v: F.trim(F.substring_index(collapse(v), "Text is machine generated", 1))), lambda v: v != "")
    whole = lambda v: (F.length(v) >= least) & ~v.endswith("...") & ~v.endswith("…")
    longest = lambda xs: best(xs, F.length)
    cleaned = [clean(g) for g in groups]
    return F.coalesce(*[longest(F.filter(x, whole)) for x in cleaned], *[longest(x) for x in cleaned], F.lit(""))


def is_placeholder(name: str, x: Column) -> Column:
    """Whether a packet's field is blank, or a word for nothing."""
    text = collapse(or_empty_column(x))
    return (text == "") | key(text).isin(*PLACEHOLDERS[name])


def survive(packets: DataFrame, crossref: DataFrame, pubmed: DataFrame, unpaywall: DataFrame | None = None) -> DataFrame:
    """packets with the gaps filled from registries, by packet_id, in order: see survivorship."""
    return survivorship.survive(packets, {"crossref": crossref, "pubmed": pubmed} | ({"unpaywall": unpaywall} if unpaywall is not None else {}))


def gate(packets: DataFrame) -> DataFrame:
    """packets with `issues`, sorted, and `ok`: what keeps a packet from being used."""
    title, abstract, body = strip(or_empty("title")), strip(or_empty("abstract")), strip(or_empty("body_markdown"))
    doi, url = F.trim(or_empty("doi")), F.trim(or_empty("reference_url"))
    none = F.array().cast("array<string>")
    retrieval = F.array_union(F.coalesce("retrieval_issues", none), F.coalesce("consistency", none))
    tests = {
        "invalid_title": (title == "") | F.regexp_like(title, F.lit("(?i)" + classify.FATAL_TITLE)),
        "insufficient_source_evidence": (F.length(abstract) < 120) & (F.length(body) < 800),
        "polluted_authors": F.length(or_empty("authors")) > 1200,
        "invalid_doi": (doi != "") & ~F.regexp_like(doi, F.lit(_DOI_WHOLE)),
        **{f"missing_or_placeholder_{c}": is_placeholder(c, F.col(c)) for c in PLACEHOLDERS},
        "invalid_reference_url": ~ids.valid_http_url(url),
        "doi_reference_url_mismatch": ids.valid_http_url(url) & (doi != "") & (F.lower(url) != F.lower(F.concat(F.lit("https://doi.org/"), doi))),
        "truncated_abstract": abstract.endswith("...") | abstract.endswith("…"),
    }
    found = F.array_union(F.array_intersect(retrieval, F.array(*map(F.lit, classify.FATAL_ISSUES))), classify.names_where(tests))
    return packets.withColumn("issues", F.array_sort(found)).withColumn("ok", F.size("issues") == 0)


def identifiers(doi: Column, *urls: Column) -> Column:
    """What a source may be known by: its DOI in both forms and its urls; each once, whatever the case and the last slash."""
    good = F.regexp_like(or_empty_column(doi), F.lit(_DOI_WHOLE))
    values = F.array_compact(F.array(F.when(good, F.concat(F.lit("https://doi.org/"), doi)), F.when(good, doi), *[or_null(F.trim(or_empty_column(u))) for u in urls]))
    low = lambda v: F.regexp_replace(F.lower(v), "/+$", "")
    keys = F.transform(values, low)
    return F.filter(values, lambda v, i: F.array_position(keys, low(v)) == i + 1)


def best_attempt(attempts: DataFrame, source: str, score: Column, number: str) -> DataFrame:
    """Of each source the attempt with the highest score; the later of equals."""
    at = F.row_number().over(W.partitionBy(source).orderBy(score.desc(), F.desc(number)))
    return attempts.withColumn("__at", at).where("__at = 1").drop("__at")


def best_plan(attempts: DataFrame, source: str, plan: str = "plan") -> DataFrame:
    """attempts(…, approved, issues of structs with severity, attempt): of each source the approved plan, else the one with fewest blocking, then actionable issues, then the earliest."""
    severities = F.coalesce(F.transform("issues", lambda i: i["severity"]), F.array().cast("array<string>"))
    blocking = F.size(F.filter(severities, lambda x: x == "blocking"))
    actionable = F.size(F.filter(severities, lambda x: x.isin("review", "blocking")))
    quality = F.struct((~F.coalesce("approved", F.lit(False))).alias("refused"), blocking.alias("blocking"), actionable.alias("actionable"), F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return attempts.groupBy(source).agg(F.min_by(plan, quality).alias(plan), F.min(quality).alias("quality")).select(source, plan, "quality.*")


def registry_summary(work: Column) -> Column:
    """A registry's record, its JSON as text, as one flat struct: names joined, first title and journal, the first date there is."""
    dates = "struct<`date-parts`:array<array<int>>>"
    x = F.from_json(work, f"DOI string, title array<string>, `container-title` array<string>, author array<struct<given:string,family:string>>, `published-print` {dates}, `published-online` {dates}, issued {dates}, abstract string, score double, URL string")
    names = F.transform(F.coalesce(x["author"], F.array().cast("array<struct<given:string,family:string>>")), lambda a: collapse(F.concat_ws(" ", or_null(a["given"]), or_null(a["family"]))))
    first = lambda xs: collapse(F.coalesce(F.get(xs, F.lit(0)), F.lit("")))
    day = lambda d: date_from_parts(F.get(x[d]["date-parts"], F.lit(0)))
    return F.struct(
        collapse(F.coalesce(x["DOI"], F.lit(""))).alias("doi"),
        first(x["title"]).alias("title"),
        F.array_join(F.filter(names, lambda n: n != ""), ", ").alias("authors"),
        first(x["container-title"]).alias("journal"),
        F.coalesce(*[day(d) for d in ("published-print", "published-online", "issued")], F.lit("")).alias("pub_date"),
        strip_markup(F.coalesce(x["abstract"], F.lit(""))).alias("abstract"),
        F.coalesce(x["score"], F.lit(0.0)).alias("score"),
        collapse(F.coalesce(x["URL"], F.lit(""))).alias("url"),
    )


def fallback_reasons(issues: Column, error: Column, has_data: Column, forced: Column) -> Column:
    """Why a second way to read a source was tried; empty if there was no need."""
    none = F.array().cast("array<string>")
    found = F.coalesce(issues, none)
    needed = error.isNotNull() | ~has_data | (F.size(found) > 0)
    said = F.when(error.isNotNull(), F.array(F.concat(F.lit("primary_fetch_failed: "), error))).when(has_data, found).otherwise(F.array(F.lit("no_primary_data")))
    return F.when(forced, F.array(F.lit("forced"))).when(needed, said).otherwise(none)


def new_page_recommendation(packets: DataFrame, rejected: DataFrame, reason: Column) -> DataFrame:
    """packets(packet_id, title, keywords, abstract, study_type), rejected(packet_id, path, title): records that a person must look at; nothing is made from them by itself."""
    hits = rejected.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct(or_empty("path").alias("path"), or_empty("title").alias("title")))).alias("rejected_existing_targets"))
    words_ = F.filter(F.transform(F.split(or_empty("keywords"), "[,;]"), lambda k: strip(k)), lambda k: k != "")
    scope = F.when(classify.is_preclinical(F.col("title"), F.col("abstract"), F.col("study_type"), F.col("keywords")), "animal").otherwise(F.coalesce(or_null("study_type"), F.lit("unspecified")))
    flat = packets.select("packet_id", F.lit("consider_new_article").alias("recommendation"), strip(F.coalesce(or_null("title"), F.lit("Untitled research source"))).alias("proposed_title"), F.slice(words_, 1, 8).alias("source_entities"), scope.alias("evidence_scope"), reason.alias("rationale"))
    out = flat.join(hits, "packet_id", "left")
    return out.withColumn("rejected_existing_targets", F.coalesce("rejected_existing_targets", F.array().cast("array<struct<path:string,title:string>>"))).withColumn("requires_human_review", F.lit(True))


def page_digest(markdown: Column, most: int) -> Column:
    """Front matter, headings and the first 1000 characters of a page, at most so many characters."""
    front = F.regexp_extract(or_empty_column(markdown), r"(?s)^---\n.*?\n---\n?", 0)
    rest = strip(F.substring(markdown, F.length(front) + 1, F.length(markdown)))
    headings = F.array_join(F.regexp_extract_all(markdown, F.lit(r"(?m)^#{2,6}\s+.+$"), F.lit(0)), "\n")
    return F.substring(F.array_join(F.filter(F.array(strip(front), headings, F.substring(rest, 1, 1000)), lambda p: p != ""), "\n\n"), 1, most)
