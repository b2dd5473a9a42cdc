"""Bounded clean-up of plan bullets with a log, the placement rule for compounds, and seeds for missing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, udfs
from ..functions.text import has_phrase, key, or_empty, strip, strip_citations, words
from ..operators.catalog import ngrams
from .validate import GENERIC_SUBSECTIONS, LEAST_QUOTE, NEAR, property_heading

COMPOUND = r"(?i)\b(?:component|compound|metabolite|constituent|phytochemical)s?\b"
NAMED = r"\b([A-Za-z][A-Za-z-]{4,})\s+\(([A-Z][A-Z0-9-]{1,9})\)(?!.{0,40}\b(?:[Cc]ells?|[Pp]atients?|[Dd]isease|[Mm]alignancy|[Cc]ancer|[Tt]umou?r|[Ss]yndrome|[Mm]odels?)\b)"
#: Category names too general for a page, and the scores of what names one.
GENERAL_CATEGORIES = ("", "natural healing", "chemicals")
BY_ALERT, BY_TITLE, BY_TEXT = 300, 200, 80


def source_span(evidence: Column, passage: Column) -> Column:
    """The passage as the source writes it, white space aside; empty if it isn't there."""
    tokens = F.transform(F.filter(F.split(strip(or_empty(passage)), r"(?U)\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, r"([^\w\s])", r"\\$1"))
    spaced = F.call_function("regexp_extract", evidence, F.concat(F.lit("(?U)"), F.array_join(tokens, r"\s+")), F.lit(0))
    return F.when(or_empty(passage) == "", "").when(F.contains(evidence, passage), passage).when(F.size(tokens) == 0, "").otherwise(spaced)


def bullets(df: DataFrame) -> DataFrame:
    """df(heading, text, source_quote, subsection, claim_kind, n_references, evidence): the bullets that stay, cleaned, and `actions`; the others have `kept` false."""
    quote = strip(or_empty("source_quote"))
    df = df.withColumn("__span", source_span(F.col("evidence"), quote))
    provable = F.length(key(F.col("__span"))) >= LEAST_QUOTE
    text = strip(or_empty("text"))
    clean = strip_citations(text)
    shaped = (text != "") & ~F.startswith(text, F.lit("-")) & ~F.contains(text, F.lit("[^"))
    df = df.withColumns({"__ok": provable, "__text": text, "__clean": clean, "__quoted": strip_citations(F.col("__span")), "__shaped": shaped})
    near = lambda x: F.coalesce(udfs.token_similarity(F.when(F.col("__ok"), x), F.when(F.col("__ok"), F.col("__span"))), F.lit(0.0)) >= NEAR
    df = df.withColumns({"__safe": F.col("__shaped") & near(F.col("__clean")), "__from_quote": near(F.col("__quoted"))})
    grouped = key(or_empty("heading")).endswith("healing properties") & key(or_empty("subsection")).isin(*GENERIC_SUBSECTIONS)
    kept = F.col("__ok") & (F.col("__safe") | F.col("__from_quote"))
    actions = F.array_compact(
        F.array(
            F.when(~F.col("__ok"), "dropped_unprovable_bullet"),
            F.when(F.col("__ok") & (F.col("__span") != quote), "restored_source_whitespace"),
            F.when(F.col("__ok") & (F.coalesce("n_references", F.lit(0)) > 0), "removed_external_reference_fields"),
            F.when(F.col("__ok") & grouped, "added_property_subsection"),
            F.when(F.col("__ok") & ~F.col("__safe") & ~F.col("__from_quote"), "dropped_unrenderable_bullet"),
            F.when(F.col("__ok") & ~F.col("__safe") & F.col("__from_quote"), "replaced_text_with_source_quote"),
            F.when(F.col("__ok") & F.col("__safe") & (F.col("__clean") != text), "removed_publisher_markers"),
        )
    )
    heading = F.when(grouped, property_heading(text, F.col("__span"), F.col("claim_kind"))).otherwise(F.col("subsection"))
    new_text = F.when(F.col("__safe"), F.col("__clean")).when(F.col("__from_quote"), F.col("__quoted")).otherwise(text)
    out = df.withColumns({"kept": kept, "actions": actions, "__new": new_text, "__heading": heading})
    return out.withColumns({"text": F.col("__new"), "subsection": F.col("__heading"), "source_quote": F.when(F.col("__ok"), F.col("__span")).otherwise(F.col("source_quote")), "n_references": F.lit(0)}).drop("__span", "__ok", "__text", "__clean", "__quoted", "__shaped", "__safe", "__from_quote", "__new", "__heading")


def compounds(sentences: DataFrame, plan_bullets: DataFrame, targets: DataFrame) -> DataFrame:
    """sentences(plan_id, sentence), plan_bullets(plan_id, bullet, text), targets(plan_id, markdown): compounds `Name (ACR)` that two bullets or more bring to a page which names neither."""
    s = sentences.where(F.regexp_like("sentence", F.lit(COMPOUND)))
    pairs = F.arrays_zip(F.regexp_extract_all("sentence", F.lit(NAMED), F.lit(1)).alias("name"), F.regexp_extract_all("sentence", F.lit(NAMED), F.lit(2)).alias("acronym"))
    found = s.select("plan_id", "sentence", F.explode(pairs).alias("p")).select("plan_id", "sentence", "p.name", "p.acronym").dropDuplicates(["plan_id", "name", "acronym"])
    page = targets.select("plan_id", F.concat(F.lit(" "), key(or_empty("markdown")), F.lit(" ")).alias("page"))
    new = found.join(page, "plan_id").where(~F.contains("page", key(F.col("name"))) & ~F.contains("page", F.concat(F.lit(" "), F.lower("acronym"), F.lit(" "))))
    told = new.join(plan_bullets, "plan_id").where(F.regexp_like("text", F.concat(F.lit(r"(?i)\b(?:"), "name", F.lit("|"), "acronym", F.lit(r")\b"))))
    return told.groupBy("plan_id", "name", "acronym", "sentence").agg(F.count("*").alias("n"), F.min("bullet").alias("bullet_index")).where("n >= 2").withColumn("code", F.lit("unsafe_context_inference"))


def page_seeds(packets: DataFrame, categories: DataFrame, existing: DataFrame, domain: str, most_words: int = 6) -> DataFrame:
    """packets(packet_id, title, abstract, keywords, alert), categories(category), existing(path): for each packet the best category whose name it asserts and that has no page of its own."""
    c = categories.select("category", key(F.regexp_extract("category", "([^/]+)/*$", 1)).alias("entity")).where(~F.col("entity").isin(*GENERAL_CATEGORIES))
    whole = key(F.concat_ws(" ", or_empty("title"), or_empty("abstract"), or_empty("keywords"), or_empty("alert")))
    singular = F.regexp_replace("entity", "(?:ies|s)$", "")
    grams = packets.select("packet_id", F.explode(F.array_distinct(F.flatten(F.array(*[ngrams(words(whole), n) for n in range(1, most_words + 1)])))).alias("g")).withColumn("stem", F.regexp_replace("g", "(?:ies|s|y)$", ""))
    pairs = grams.join(c.withColumn("stem", F.regexp_replace(singular, "y$", "")), "stem").select("packet_id", "category", "entity").distinct().join(packets, "packet_id")
    alert = key(or_empty("alert"))
    text = key(F.concat_ws(" ", or_empty("title"), or_empty("abstract"), or_empty("keywords")))
    score = F.when((alert != "") & (has_phrase(F.col("entity"), alert) | has_phrase(alert, F.col("entity"))), BY_ALERT).otherwise(0) + F.when(has_phrase(key(or_empty("title")), F.col("entity")), BY_TITLE).otherwise(0) + F.when(has_phrase(text, F.col("entity")), BY_TEXT).otherwise(0)
    ranked = pairs.withColumn("score", score).where("score > 0")
    top = ranked.groupBy("packet_id").agg(F.max(F.struct("score", F.size(F.split("category", "/")).alias("depth"), "entity", "category")).alias("x")).select("packet_id", "x.score", "x.entity", "x.category")
    out = top.withColumn("path", F.concat("category", F.lit("/"), F.regexp_replace("entity", " +", "-"), F.lit(".md"))).where(ids.safe_new_path("path", domain))
    return out.join(existing.select("path"), "path", "left_anti")
