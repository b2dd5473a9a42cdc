"""Rules over edit plans, one row for each bullet or target; codes are gathered at the end.

plans: plan_id, packet_id, decision, study_type, targets (array of structs, see TARGET). A rule is a test on columns; none looks at
two rows, but for the rules on repeated sections and quotes, which are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, ids, udfs
from ..functions.text import collapse, has_phrase, key, or_empty
from ..operators import packets
from ..operators.catalog import names_entity

#: Fixed values.
DECISIONS = ("publish_changes", "duplicate", "needs_review")
CHANGES = ("publish_changes", "append_existing", "create_new")
OPERATIONS = ("append_existing", "create_new")
SCOPES = ("review_summary", "human", "animal", "in_vitro", "mechanistic", "composition")
KINDS = ("source_finding", "background_fact")
PLACEMENT = ("wrong_target_page", "entity_not_supported", "wrong_heading", "existing_content_conflict", "duplicate_content", "unsafe_context_inference", "new_article_not_warranted", "wrong_category")
EVIDENCE = ("unsupported_claim", "missing_source_provenance", "claim_origin_misclassified", "medical_overclaim", "study_type_inflation", "merged_ideas", "source_integrity_concern", "limitation_omitted")
SEVERITIES = ("warning", "review", "blocking")
NO_LEAST_SEVERITY = ("merged_ideas",)
CONTRADICTIONS = {"unsupported_claim": ("source supports", "is supported by the source", "source supported", "text is supported", "claim is supported", "it is supported"), "medical_overclaim": ("does not overclaim", "appropriately scoped", "correctly scoped"), "study_type_inflation": ("properly scoped", "correctly scoped", "evidence scope is correct"), "merged_ideas": ("ideas are separate", "draft separates", "does not merge"), "wrong_target_page": ("target is appropriate", "correct target", "page is appropriate")}
GENERIC_SUBSECTIONS = ("", "animal evidence", "animal models", "preclinical evidence", "preclinical evidence animal studies", "research findings", "supporting background")
SIGNALS = (
    ("Meta Analysis", r"\bmeta analys\w*"),
    ("Review", r"\b(?:systematic |scoping |narrative |umbrella )?review\b"),
    ("Animal Study", r"\b(?:in vivo|rats?|mice|mouse|murine|rodents?|rabbits?|zebrafish|porcine|piglets?|canine|animal(?: models?| stud(?:y|ies))?s?)\b"),
    ("Human Study", r"\b(?:randomi[sz]ed(?: controlled)? trial|double blind|placebo controlled|clinical trial|patients?|participants?|volunteers?|cohort|cross sectional|human(?: subjects?| trials?| stud(?:y|ies))?s?)\b"),
    ("In Vitro", r"\b(?:in vitro|cell lines?|cell cultures?|cultured cells)\b"),
)
PROPERTIES = (
    ("Blood Pressure", r"\bblood pressure\b|\bhypertension\b"),
    ("Lipid Metabolism", r"\blipid\b|\btriglyceride\b|\bcholesterol\b|\bldl\b|\bhdl\b"),
    ("Vitamin A Status", r"\bvitamin a\b|\bretinoid\b|\bretinol\b"),
    ("Nutrient Composition", r"\bnutri\w*\b|\bvitamin\w*\b|\bmineral\w*\b|\bfibers?\b|\bphytochemical\w*\b"),
    ("Carotenoid Content", r"\bcarotenoid\w*\b|\blycopene\b|\bcryptoxanthin\b|\bcarotene\w*\b"),
    ("Glycemic Control", r"\bglucose\b|\bglyc\w*\b|\binsulin\w*\b|\bdiabet\w*\b|\bhoma ir\b"),
    ("Antioxidant and Anti-inflammatory Activity", r"\bantioxidant\b|\banti inflammatory\b|\bcardioprotective\b"),
    ("Traditional Uses", r"\btraditional\b|\bethnobotan\w*\b|\bfolk\b|\bhistorical\b"),
)
NEAR, LEAST_QUOTE, MOST_TARGETS, MOST_BULLETS = 0.68, 35, 4, 16
ENTITY_REJECTIONS = ("wrong_target_page", "unsafe_context_inference", "new_article_not_warranted", "wrong_category")
BULLET = "struct<text:string,source_quote:string,source_section:string,claim_kind:string,evidence_scope:string,subsection:string,n_references:int>"
TARGET = f"struct<operation:string,target_path:string,target_entity:string,heading:string,parent_heading:string,rationale:string,title:string,bullets:array<{BULLET}>>"


def study_type(title: Column, keywords: Column, abstract: Column, hints: Column) -> Column:
    """The first field with a signal decides; null if none has."""
    rules = lambda x: classify.first_of([(classify.like(key(or_empty(x)), p), n) for n, p in SIGNALS])
    return F.coalesce(*[rules(x) for x in (title, keywords, abstract, hints)])


def property_heading(text: Column, quote: Column, kind: Column) -> Column:
    both = key(F.concat_ws(" ", text, quote))
    found = classify.first_of([(classify.like(both, p), n) for n, p in PROPERTIES])
    return F.coalesce(found, F.when(kind == "source_finding", "Metabolic Health").otherwise("Other Reported Properties"))


def mere_mention(entity: Column, passage: Column) -> Column:
    e, p = key(entity), key(passage)
    verb = F.concat(e, F.lit(r"\s+(?:was|were|is|are)\s+(?:only\s+)?(?:mentioned|listed|named)"), F.lit(r"|(?:mentioned|listed|named)\s+(?:the\s+)?"), e)
    return (e != "") & F.regexp_like(p, verb)


def section_present(title: Column, abstract: Column, body: Column, section: Column) -> Column:
    """Whether a section is the title, the abstract, or a heading of the body."""
    s = key(or_empty(section))
    lines = F.transform(F.split(or_empty(body), "\n"), lambda x: F.struct(F.regexp_like(F.trim(x), F.lit(r"^#{1,6}\s+")).alias("marked"), key(F.regexp_replace(F.trim(x), r"^#{1,6}\s*", "")).alias("k")))
    inside = F.exists(lines, lambda x: (x["k"] == s) | (x["marked"] & has_phrase(x["k"], s)))
    return F.when(s == "title", F.trim(or_empty(title)) != "").when(s == "abstract", F.trim(or_empty(abstract)) != "").otherwise((s != "") & inside)


def exploded(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each target, and one for each bullet."""
    t = plans.select("plan_id", "packet_id", "decision", F.posexplode("targets").alias("target", "t")).select("plan_id", "packet_id", "decision", "target", "t.*")
    b = t.select(*[c for c in t.columns if c != "bullets"], F.posexplode("bullets").alias("bullet", "b")).select("*", "b.*").drop("b")
    return t, b


def _codes(df: DataFrame, prefix: Column, tests: dict[str, Column]) -> DataFrame:
    found = classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    return df.select("plan_id", F.explode(found).alias("c")).select("plan_id", "c") if prefix is None else df.select("plan_id", prefix.alias("p"), F.explode(found).alias("c")).select("plan_id", F.concat("p", F.lit("_"), "c").alias("c"))


def validate(plans: DataFrame, packets_: DataFrame, pages: DataFrame, domain: str) -> DataFrame:
    """plan_id, issues, ok. packets_(packet_id, title, abstract, body_markdown, study_type, keywords), pages(path, title): those that may be appended to."""
    targets, bullets = exploded(plans)
    source = packets_.select("packet_id", packets.evidence(F.col("title"), F.col("abstract"), F.col("body_markdown")).alias("evidence"), F.col("title").alias("p_title"), F.col("abstract").alias("p_abstract"), F.col("body_markdown").alias("p_body"), classify.is_preclinical(F.col("title"), F.col("abstract"), F.col("study_type"), F.col("keywords")).alias("preclinical"), classify.animal_model(F.col("title"), F.col("abstract"), F.col("keywords")).alias("model"), F.col("study_type").alias("p_type"), study_type(F.col("title"), F.col("keywords"), F.col("abstract"), F.lit("")).alias("p_class"))
    changing = F.col("decision").isin(*CHANGES)
    n = F.coalesce(F.size("targets"), F.lit(0))
    planned, recorded = key(or_empty("study_type")), key(or_empty("p_type"))
    generic = recorded.isin("article", "research article", "original article") & F.col("preclinical") & classify.like(planned, classify.PRECLINICAL_PLAN)
    agrees = (planned == recorded) | ((planned != "") & (planned == key(or_empty("p_class")))) | generic
    whole = plans.join(source, "packet_id", "left")
    found = _codes(whole, None, {"invalid_decision": ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "invalid_target_proposal_count": changing & ~n.between(1, MOST_TARGETS), "study_type_mismatch": changing & n.between(1, MOST_TARGETS) & ~agrees})
    known = pages.select(F.col("path").alias("target_path"), F.col("title").alias("page_title"), F.lit(True).alias("listed"))
    t = targets.where(F.col("decision").isin(*CHANGES)).join(known, "target_path", "left")
    again = F.row_number().over(W.partitionBy("plan_id", "target_path", key(or_empty("heading"))).orderBy("target")) > 1
    t = t.withColumns({"again": again, "listed": F.coalesce("listed", F.lit(False)), "findings": F.size(F.filter("bullets", lambda b: b["claim_kind"] == "source_finding"))})
    new = F.col("operation") == "create_new"
    stem = F.regexp_extract("target_path", r"([^/]+?)(?:\.md)?$", 1)
    size = F.coalesce(F.size("bullets"), F.lit(0))
    label = F.concat(F.lit("target_"), F.col("target").cast("string"))
    tests = {
        "invalid_operation": ~F.col("operation").isin(*OPERATIONS),
        "not_in_candidates": (F.col("operation") == "append_existing") & ~F.col("listed"),
        "invalid_new_article_path": new & ~ids.safe_new_path("target_path", domain),
        "new_article_already_exists": new & F.col("listed"),
        "invalid_heading": ~F.regexp_like(or_empty("heading"), F.lit(r"^#{2,6}\s+\S")),
        "invalid_parent_heading": (or_empty("parent_heading") != "") & ~F.regexp_like(or_empty("parent_heading"), F.lit(r"^#{2,5}\s+\S")),
        "duplicate_target": F.col("again"),
        "missing_target_entity": F.trim(or_empty("target_entity")) == "",
        "entity_mismatch": (F.trim(or_empty("target_entity")) != "") & ~names_entity(F.col("target_entity"), or_empty(F.when(new, F.col("title")).otherwise(F.col("page_title"))), stem),
        "missing_rationale": F.trim(or_empty("rationale")) == "",
        "missing_new_article_title": new & (F.trim(or_empty("title")) == ""),
        "invalid_bullet_count": ~size.between(1, MOST_BULLETS),
        "new_article_requires_source_finding": new & size.between(1, MOST_BULLETS) & (F.col("findings") == 0),
    }
    found = found.unionAll(_codes(t, label, tests))
    b = bullets.where(F.col("decision").isin(*CHANGES)).join(source, "packet_id", "left")
    quote = F.trim(or_empty("source_quote"))
    text = F.trim(or_empty("text"))
    prefix = F.concat(F.lit("In "), F.col("model"), F.lit(", "))
    bare = F.when((F.col("model") != "") & F.startswith(F.lower(text), F.lower(prefix)), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)
    exact = (F.length(key(quote)) >= LEAST_QUOTE) & packets.exact_passage(F.col("evidence"), quote)
    first = F.min("target").over(W.partitionBy("plan_id", key(quote)))
    b = b.withColumns({"__exact": exact, "__bare": bare, "__first": first})
    # the similarity leaves the JVM, so only bullets whose quote is exact get there
    b = b.withColumn("__near", udfs.token_similarity(F.when(F.col("__exact"), F.col("__bare")), F.when(F.col("__exact"), quote)))
    section, entity, finding = key(or_empty("source_section")), F.col("target_entity"), F.col("claim_kind") == "source_finding"
    named = F.trim(or_empty("target_entity")) != ""
    label = F.concat(F.lit("target_"), F.col("target").cast("string"), F.lit("_bullet_"), F.col("bullet").cast("string"))
    subsection = collapse(or_empty("subsection"))
    tests = {
        "invalid_text": (text == "") | F.startswith(text, F.lit("-")) | F.contains(text, F.lit("[^")),
        "quote_not_in_source": ~F.col("__exact"),
        "not_near_verbatim": F.col("__near") < NEAR,
        "invalid_claim_kind": ~F.coalesce(F.col("claim_kind").isin(*KINDS), F.lit(False)),
        "invalid_evidence_scope": ~F.coalesce(F.col("evidence_scope").isin(*SCOPES), F.lit(False)),
        "missing_property_subsection": key(or_empty("heading")).endswith("healing properties") & (key(subsection).isin(*GENERIC_SUBSECTIONS) | (F.length(subsection) > 80) | F.startswith(subsection, F.lit("#"))),
        "source_section_not_found": ~section_present(F.col("p_title"), F.col("p_abstract"), F.col("p_body"), F.col("source_section")),
        "source_section_not_claim_bearing": F.regexp_like(section, F.lit("references|bibliography|works cited")),
        "claim_origin_misclassified": finding & F.contains(section, F.lit("introduction")),
        "source_finding_scope_must_be_animal": finding & F.col("preclinical") & ~F.coalesce(F.col("evidence_scope").isin("animal", "composition"), F.lit(False)),
        "entity_not_supported_by_passage": named & (~has_phrase(key(quote), key(entity)) | ~has_phrase(key(text), key(entity)) | mere_mention(entity, quote)),
        "external_reference_not_allowed": F.coalesce("n_references", F.lit(0)) > 0,
        "methods_statement_not_effect_claim": (or_empty("evidence_scope") != "composition") & ~F.contains(key(or_empty("heading")), F.lit("composition")) & classify.is_methods_statement(F.col("__bare")),
        "claim_assigned_to_multiple_targets": (key(quote) != "") & (F.col("__first") != F.col("target")),
    }
    found = found.unionAll(_codes(b, label, tests))
    gathered = found.groupBy("plan_id").agg(F.array_sort(F.collect_set("c")).alias("issues"))
    return plans.select("plan_id").join(gathered, "plan_id", "left").select("plan_id", F.coalesce("issues", F.array().cast("array<string>")).alias("issues")).withColumn("ok", F.size("issues") == 0)


def bullet_evidence(plans: DataFrame, packets_: DataFrame) -> DataFrame:
    """For each bullet of plans what speaks for it: plan_id, target, bullet, page, scope, entity, exact, similarity."""
    _, b = exploded(plans)
    source = packets_.select("packet_id", packets.evidence(F.col("title"), F.col("abstract"), F.col("body_markdown")).alias("evidence"), classify.animal_model(F.col("title"), F.col("abstract"), F.col("keywords")).alias("model"))
    b = b.join(source, "packet_id", "left")
    text, quote, entity = F.trim(or_empty("text")), F.trim(or_empty("source_quote")), or_empty("target_entity")
    prefix = F.concat(F.lit("In "), F.col("model"), F.lit(", "))
    bare = F.when((F.col("model") != "") & F.startswith(F.lower(text), F.lower(prefix)), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)
    named = (F.trim(entity) == "") | (has_phrase(key(quote), key(entity)) & has_phrase(key(text), key(entity)))
    page = F.regexp_extract(or_empty("target_path"), "([^/]*)$", 1)
    return b.select("plan_id", "target", "bullet", F.when(page == "", "?").otherwise(page).alias("page"), F.coalesce("evidence_scope", F.lit("—")).alias("scope"), named.alias("entity"), packets.exact_passage(F.col("evidence"), quote).alias("exact"), F.round(udfs.token_similarity(bare, quote), 2).alias("similarity"))


def gate_table(evidence: DataFrame) -> DataFrame:
    """bullet_evidence() as a Markdown table for each plan."""
    sign = lambda c: F.when(F.col(c), "✓").otherwise("✗")
    row = F.concat_ws(" | ", F.concat(F.lit("| `"), "page", F.lit("`")), F.col("bullet").cast("string"), "scope", sign("entity"), sign("exact"), F.concat(F.format_string("%.2f", "similarity"), F.lit(" |")))
    # a plan has few bullets
    per = evidence.groupBy("plan_id").agg(F.sort_array(F.collect_list(F.struct("target", "bullet", row.alias("row")))).alias("x"))
    head = F.lit("| Target | Bullet | Scope | Entity | Exact quote | Near-verbatim |\n|---|---|---|---|---|---|")
    return per.select("plan_id", F.concat_ws("\n", head, F.array_join("x.row", "\n")).alias("table"))


def critic_issues(issues: DataFrame, kind: str) -> DataFrame:
    """issues(review_id, code, severity, bullet_index, explanation, source_quote, target_quote, evidence, target, n_bullets, operation) with `errors`, `severity` raised to the code's least, and `accepted`."""
    codes = PLACEMENT if kind == "placement" else EVIDENCE
    sq, tq, code = or_empty("source_quote"), or_empty("target_quote"), or_empty("code")
    s_exact = packets.exact_passage(F.col("evidence"), sq)
    t_exact = packets.exact_passage(or_empty("target"), tq)
    wrong_page = code == "wrong_target_page"
    s_bad = (sq != "") & ~s_exact & (F.lit(kind == "evidence") | wrong_page | ~t_exact)
    t_bad = (tq != "") & ~t_exact & (wrong_page | ~s_exact)
    s_kept, t_kept = F.when(s_exact | s_bad, sq).otherwise(""), F.when(t_exact | t_bad, tq).otherwise("")
    said = key(or_empty("explanation"))
    contradicts = F.lit(False)
    for c, phrases in CONTRADICTIONS.items():
        for p in phrases:
            contradicts = contradicts | ((code == c) & F.contains(said, F.lit(p)))
    tests = {
        "invalid_issue_code": ~code.isin(*codes),
        "invalid_severity": ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)),
        "missing_explanation": F.trim(or_empty("explanation")) == "",
        "invalid_bullet_index": F.col("bullet_index").isNotNull() & ~F.col("bullet_index").between(0, F.col("n_bullets") - 1),
        "source_quote_not_exact": s_bad,
        "target_quote_not_exact": t_bad,
        "missing_evidence_quote": (s_kept == "") & (t_kept == ""),
        "evidence_review_requires_source_quote": F.lit(kind == "evidence") & (s_kept == ""),
        "wrong_target_requires_source_and_target_quotes": wrong_page & (or_empty("operation") != "create_new") & ((s_kept == "") | (t_kept == "")),
        "self_contradictory_issue": contradicts,
    }
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    raised = F.when((F.col("severity") == "warning") & code.isin(*codes) & ~code.isin(*NO_LEAST_SEVERITY) & (rank > 0), "review").otherwise(F.col("severity"))
    found = F.array_sort(classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}))
    return issues.withColumns({"errors": found, "severity": raised, "source_quote": s_kept, "target_quote": t_kept}).withColumn("accepted", F.size("errors") == 0)


def combine_reviews(issues: DataFrame) -> DataFrame:
    """Accepted issues of a review as a decision."""
    good = F.col("accepted")
    per = issues.groupBy("review_id").agg(F.count_if(good & F.col("severity").isin("review", "blocking")).alias("actionable"), F.count_if(good & (F.col("severity") == "blocking")).alias("blocking"), F.count_if(~good).alias("rejected"), F.count_if(good & F.col("code").isin(*ENTITY_REJECTIONS) & F.col("severity").isin("review", "blocking")).alias("entity_rejections"), F.count_if(good & (F.col("code") == "limitation_omitted") & F.col("severity").isin("review", "blocking")).alias("balance"))
    return per.withColumn("recommendation", F.when(F.col("actionable") == 0, "approve").when(F.col("blocking") > 0, "needs_review").otherwise("revise"))


def suggested_action(cited: Column, matched: Column) -> Column:
    return F.when(cited, "already_cited").when(matched, "append_existing").otherwise("new_article")


def repair_hints(issues: Column, rules: list[tuple[str, str]]) -> Column:
    """The hint of each rule whose code is part of an issue, once, in the rules' order."""
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(h).alias("h")) for c, h in rules])
    return F.array_distinct(F.transform(F.filter(table, lambda r: F.exists(issues, lambda i: F.contains(i, r["c"]))), lambda r: r["h"]))


def repair_kept_bullets(before: Column, after: Column) -> Column:
    """Whether each text of the first plan is part of one of the second's."""
    return F.forall(before, lambda t: (t == "") | F.exists(after, lambda u: F.contains(u, t)))


def markers_covered(cited: Column, represented: Column) -> Column:
    """Whether each citation of a text stands among those that a plan represents."""
    plain = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), classify.canonical_marker)
    return F.size(F.array_except(plain(cited), plain(represented))) == 0


def finding_counts(issues: DataFrame, by: str = "review_id") -> DataFrame:
    """Issues of each review by severity."""
    s = F.col("severity")
    return issues.groupBy(by).agg(F.count("*").alias("issues"), F.count_if(s == "blocking").alias("blocking"), F.count_if(s.isin("review", "blocking")).alias("actionable"))


def blocks_publication(approved: Column, recommendations: Column) -> Column:
    """Whether a review stops a plan: not approved, and no review of any target, or one that neither approves nor asks for a change."""
    bad = F.exists(recommendations, lambda r: ~F.coalesce(r.isin("approve", "revise"), F.lit(False)))
    return ~F.coalesce(approved, F.lit(False)) & (F.coalesce(F.size(recommendations), F.lit(0)) < 1) | (~F.coalesce(approved, F.lit(False)) & F.coalesce(bad, F.lit(True)))


def balance_findings(issues: DataFrame) -> DataFrame:
    """Findings on what a plan leaves out, with whether they can be repaired: only where the source says it word by word. issues(review_id, code, severity, source_quote, evidence)."""
    left = issues.where((F.col("code") == "limitation_omitted") & F.col("severity").isin("review", "blocking"))
    return left.withColumn("repairable", packets.exact_passage(F.col("evidence"), F.col("source_quote")))


#: What a plan may give for a new page.
NEW_PAGE = "struct<title:string,tags:array<string>,lead_kind:string,lead_text:string,lead_source_quote:string,category_rationale:string>"


def new_page_issues(page: Column, entity: Column, evidence: Column) -> Column:
    """What is wrong with the title, tags and lead of a page that a plan makes."""
    missing = page.isNull()
    none = F.array().cast("array<string>")
    tags = F.coalesce(page["tags"], none)
    bad_tags = (F.size(tags) == 0) | F.exists(tags, lambda t: F.trim(or_empty(t)) == "")
    lead, quote, kind = F.trim(or_empty(page["lead_text"])), F.trim(or_empty(page["lead_source_quote"])), F.coalesce(page["lead_kind"], F.lit("definition"))
    form = (lead != "") & classify.defines(or_empty(entity), lead)
    tests = {
        "missing_new_article_title": F.trim(or_empty(page["title"])) == "",
        "invalid_new_article_tags": bad_tags,
        "missing_new_article_entity_tag": ~bad_tags & (F.trim(or_empty(entity)) != "") & ~F.exists(tags, lambda t: has_phrase(key(t), key(or_empty(entity)))),
        "missing_category_rationale": F.trim(or_empty(page["category_rationale"])) == "",
        "invalid_lead_kind": ~kind.isin("definition", "source_grounded"),
        "lead_not_definition_form": ~form,
        "definition_lead_contains_health_claim": form & (kind == "definition") & classify.claims_benefit(lead),
        "lead_not_source_grounded": form & (kind == "source_grounded") & (~packets.exact_passage(evidence, quote) | (udfs.token_similarity(lead, quote) < NEAR)),
    }
    return F.when(missing, F.array(F.lit("missing_new_article_metadata"))).otherwise(classify.names_where({n: F.coalesce(t & ~missing, F.lit(False)) for n, t in tests.items()}))


#: What a plan may say above the bullets of a section.
SUMMARY = "struct<text:string,source_quote:string,source_section:string>"


def summary_issues(summary: Column, entity: Column, evidence: Column, section_found: Column, preclinical: Column) -> Column:
    """What is wrong with the thesis above a section's bullets; nothing if there is none."""
    text, quote = F.trim(or_empty(summary["text"])), F.trim(or_empty(summary["source_quote"]))
    proven = (F.length(key(quote)) >= LEAST_QUOTE) & packets.exact_passage(evidence, quote)
    named = F.trim(or_empty(entity)) != ""
    tests = {
        "invalid_section_summary_text": (text == "") | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("[^")),
        "section_summary_quote_not_in_source": ~proven,
        "section_summary_not_near_verbatim": proven & (udfs.token_similarity(text, quote) < NEAR),
        "section_summary_section_not_found": ~section_found,
        "section_summary_entity_not_supported": named & (~has_phrase(key(quote), key(or_empty(entity))) | ~has_phrase(key(text), key(or_empty(entity)))),
        "section_summary_missing_species_scope": preclinical & ~classify.has_species(text),
    }
    found = classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})
    return F.when(summary.isNull(), F.array().cast("array<string>")).otherwise(found)


def waived(issues: Column, targets: Column, quotes: Column) -> Column:
    """Struct of issues that stay and of those waived: an entity that a bullet doesn't name, or too many bullets, where only bullets that hold a balancing quote are concerned.

    targets: for each target its bullets' source quotes.
    """
    balancing = F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: q != "")
    own = lambda quote: (or_empty(quote) != "") & F.exists(balancing, lambda q: F.contains(q, quote) | F.contains(quote, q))
    at = lambda issue, i: F.regexp_extract(issue, r"^target_(\d+)_(?:bullet_(\d+)_entity_not_supported_by_passage|invalid_bullet_count)$", i)

    def excused(issue: Column) -> Column:
        bullets = F.get(targets, at(issue, 1).try_cast("int"))
        one = F.coalesce(own(F.get(bullets, at(issue, 2).try_cast("int"))), F.lit(False))
        others = F.size(bullets) - F.size(F.filter(bullets, own))
        return F.when(at(issue, 1) == "", F.lit(False)).when(at(issue, 2) != "", one).otherwise(F.coalesce((F.size(bullets) > 0) & others.between(1, 8), F.lit(False)))

    return F.struct(F.filter(issues, lambda i: ~excused(i)).alias("issues"), F.transform(F.filter(issues, excused), lambda i: F.concat(i, F.lit("_waived_balance_qualifier"))).alias("warnings"))


def balance_repair_issues(decision: Column, before: Column, after: Column, quotes: Column) -> Column:
    """Whether a second plan only adds what a review asked for. before, after: maps from target path to arrays of structs with text and source_quote."""
    paths = F.map_keys(before)
    texts = lambda bullets: F.transform(bullets, lambda b: or_empty(b["text"]))
    common = F.filter(paths, lambda p: F.map_contains_key(after, p))
    dropped = F.exists(common, lambda p: F.exists(texts(F.element_at(before, p)), lambda t: (t != "") & ~F.exists(texts(F.element_at(after, p)), lambda u: F.contains(u, t))))
    added = F.aggregate(common, F.lit(0), lambda n, p: n + F.greatest(F.lit(0), F.size(F.element_at(after, p)) - F.size(F.element_at(before, p))))
    all_quotes = F.flatten(F.transform(F.map_values(after), lambda bullets: F.transform(bullets, lambda b: or_empty(b["source_quote"]))))
    missing = F.exists(quotes, lambda q: (or_empty(q) == "") | ~F.exists(all_quotes, lambda x: F.contains(x, q)))
    tests = {
        "balance_repair_changed_targets": F.array_sort(paths) != F.array_sort(F.map_keys(after)),
        "balance_repair_dropped_or_rewrote_bullet": dropped,
        "balance_repair_added_unrelated_bullets": added > F.size(quotes),
        "balance_repair_qualifier_missing": missing,
    }
    found = F.array_sort(classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()}))
    return F.when(F.coalesce(decision.isin(*CHANGES), F.lit(False)), found).otherwise(F.array(F.lit("balance_repair_abandoned_plan")))


#: Products that findings may be about, and names that an older form of plans has for its only target's issues.
FORMULATION = r"\b(?:concentrates?|formulations?|extracts?|blends?)\b"
OLDER_NAMES = {"target_0_not_in_candidates": "target_not_in_candidates", "target_0_invalid_heading": "invalid_heading", "target_0_invalid_parent_heading": "invalid_parent_heading", "target_0_preclinical_heading_scope_missing": "preclinical_heading_scope_missing", "target_0_invalid_bullet_count": "invalid_bullet_count"}
#: What an older plan may give beside its bullets.
EXCLUSIONS, DEFINITION = "array<struct<source_quote:string,reason:string>>", "struct<text:string,source_quote:string>"
REFERENCES = "array<struct<citation_marker:string,reference_text:string,reference_url:string>>"


def cited_reference_issues(kind: Column, quote: Column, references: Column, evidence: Column) -> Column:
    """What is wrong with the references that a bullet names for the citations in its passage."""
    refs = F.coalesce(references, F.array().cast(REFERENCES))
    markers = F.when(kind == "background_fact", F.transform(classify.citation_markers(or_empty(quote)), classify.canonical_marker)).otherwise(F.array().cast("array<string>"))
    own = lambda r: classify.canonical_marker(or_empty(r["citation_marker"]))
    text, url = (lambda r: F.trim(or_empty(r["reference_text"]))), (lambda r: F.trim(or_empty(r["reference_url"])))
    known = lambda r: (text(r) != "") & F.contains(evidence, text(r))
    represented = F.filter(F.transform(refs, own), lambda m: m != "")
    cited = F.size(markers) > 0
    outside = lambda r: (own(r) == "") | ~F.array_contains(markers, own(r)) | ~F.contains(F.regexp_replace(or_empty(quote), r"\]\(#[^)]+\)", "]"), own(r))
    tests = {
        "source_finding_has_background_reference": (kind == "source_finding") & (F.size(refs) > 0),
        "missing_cited_reference_provenance": cited & ((F.size(refs) == 0) | (F.size(F.array_except(markers, represented)) > 0)),
        "citation_marker_not_in_passage": cited & F.exists(refs, outside),
        "cited_reference_not_in_source": F.exists(refs, lambda r: ~known(r)),
        "cited_reference_marker_mismatch": F.exists(refs, lambda r: known(r) & (own(r) != "") & ~classify.marker_matches(or_empty(r["citation_marker"]), text(r))),
        "cited_reference_url_not_in_source": F.exists(refs, lambda r: (url(r) != "") & (~ids.valid_http_url(url(r)) | ~F.contains(evidence, url(r)))),
    }
    return classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})


def exclusion_issues(exclusions: Column, evidence: Column) -> Column:
    """What is wrong with the passages that a plan says it leaves out."""
    label = lambda i, what: F.concat(F.lit("exclusion_"), i.cast("string"), F.lit(what))
    one = lambda x, i: F.array_compact(F.array(F.when((or_empty(x["source_quote"]) != "") & ~packets.exact_passage(evidence, x["source_quote"]), label(i, "_quote_not_in_source")), F.when(F.trim(or_empty(x["reason"])) == "", label(i, "_missing_reason"))))
    return F.when(exclusions.isNull(), F.array(F.lit("invalid_exclusions"))).otherwise(F.flatten(F.transform(exclusions, one)))


def formulation_issues(definition: Column, bullets: Column, evidence: Column) -> Column:
    """What is wrong with the definition of a product, which findings on animals that name one need. bullets: structs with text and evidence_scope."""
    text, quote = F.trim(or_empty(definition["text"])), F.trim(or_empty(definition["source_quote"]))
    proven = (F.length(key(quote)) >= LEAST_QUOTE) & packets.exact_passage(evidence, quote)
    on_product = lambda b: F.regexp_like(or_empty(b["evidence_scope"]), F.lit("(?i)animal|in.?vivo|preclinical")) & classify.like(key(or_empty(b["text"])), FORMULATION)
    there = definition.isNotNull()
    tests = {
        "formulation_definition_not_one_line": there & ((text == "") | F.contains(text, F.lit("\n"))),
        "formulation_definition_quote_not_in_source": there & ~proven,
        "formulation_definition_not_near_verbatim": there & proven & (udfs.token_similarity(text, quote) < NEAR),
        "formulation_definition_missing": ~there & F.exists(bullets, on_product),
    }
    return classify.names_where({n: F.coalesce(t, F.lit(False)) for n, t in tests.items()})


def older_names(issues: Column) -> Column:
    """Issues as the older form of plans, with one target, spells them."""
    names = F.create_map(*[F.lit(x) for pair in OLDER_NAMES.items() for x in pair])
    return F.transform(issues, lambda i: F.coalesce(F.try_element_at(names, i), F.regexp_replace(i, "^target_0_", "")))
