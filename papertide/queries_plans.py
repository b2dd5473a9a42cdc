"""Queries of the rules on edit plans and of the edits that they make, over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import classify, text
from .operators import packets, survivorship
from .plans import editing, normalize, validate
from .queries import _TITLE, _title, _key, query, table
from .queries_rules import _doc, joined, matches, pick, pick_sql, quoted

_QUOTES = ("The objective of this study was to evaluate whether citrus [12] lowers lipids (Miller, 2020) .", "aim was to assess whether [it](#x) helps ( ; ) .", "- Citrus [1, 2] is a fruit [^3] .", "Citrus trees are plants", "The citrus prevents colds", "10 mg of a, 2.5 µg of b and 3 g of c. End.", "10 mg of a. 2 mg of b. 3 mg of c.")
_PLAIN = ("Citrus lowers lipids.", "It helps.", "Citrus is a fruit.", "Citrus trees are plants", "The citrus prevents colds", "10 mg of a, 2.5 µg of b and 3 g of c. End.", "10 mg of a. 2 mg of b. 3 mg of c.")


@query(f"""
WITH q AS (SELECT doc_id, {pick_sql(_QUOTES, 'doc_id')} AS q FROM documents)
SELECT doc_id, {pick_sql(_PLAIN, 'doc_id')} || ' ' || lang AS thesis, {matches(_key('q'), classify.HEALTH_CLAIM)} AS claims, doc_id % 7 = 5 AS composition, {matches(_key('q'), '^(?:the )?citrus(?:es|s)?(?: fruits?| plants?| trees?| species| genus)?[ ]+(?:is|are|include|includes|comprise|comprises|refers to|denotes)[^a-z]')} AS defines FROM q JOIN documents USING (doc_id)""")
def passage_texts(spark, d):
    """Passages as theses, and whether they claim a benefit, give quantities or define an entity."""
    q = pick(_QUOTES, _doc())
    return table(spark, d, "documents").select("doc_id", F.concat(classify.thesis_text(q), F.lit(" "), "lang").alias("thesis"), classify.claims_benefit(q).alias("claims"), classify.has_composition(q).alias("composition"), classify.defines(F.lit("Citrus"), q).alias("defines"))


@query("""
SELECT doc_id, '  <!-- provenance | claim_kind: ' || CASE WHEN doc_id % 2 = 0 THEN 'background_fact' ELSE 'source_finding' END || ' | source_section: ' || lang || ' | source_quote: a &lt;b&gt; ' || source || ' | cited_references: ' || CASE WHEN doc_id % 3 = 0 THEN '[1]: x; [2]: y' ELSE 'none' END || ' -->' AS comment FROM documents""")
def provenance_comments(spark, d):
    """Where bullets come from, as comments."""
    kind, cited = F.when(_doc() % 2 == 0, "background_fact").otherwise(""), F.when(_doc() % 3 == 0, F.array(F.lit("[1]: x"), F.lit("[2]:  y")))
    return table(spark, d, "documents").select("doc_id", editing.provenance(kind, F.col("lang"), F.concat(F.lit("a  <b>\n"), "source"), cited).alias("comment"))


@query("""
WITH b AS (SELECT user_id AS plan_id, (event_id % 3)::INT AS bullet, min(event_type) AS text FROM events GROUP BY ALL), f AS (SELECT user_id AS plan_id, (event_id % 5)::INT AS i, '  <!-- review ' || (['review', 'blocking'])[1 + event_id % 2] || ' c' || (event_id % 4) || ': ' || event_type || ' -->' AS note FROM events WHERE event_id % 7 < 2),
p AS (SELECT f.plan_id, b.bullet, note FROM f LEFT JOIN b ON f.plan_id = b.plan_id AND f.i = b.bullet), n AS (SELECT plan_id, bullet, count(*) AS n, min(note) AS first FROM p GROUP BY ALL)
SELECT coalesce(b.plan_id, n.plan_id) AS plan_id, b.bullet, b.text, coalesce(n, 0)::INT AS notes, first FROM b FULL JOIN n ON b.plan_id = n.plan_id AND b.bullet IS NOT DISTINCT FROM n.bullet""")
def placed_findings(spark, d):
    """Findings of reviews at the bullets that they are on; those on none at the plan."""
    e, n = table(spark, d, "events"), F.col("event_id")
    bullets = e.groupBy(F.col("user_id").alias("plan_id"), (n % 3).cast("int").alias("bullet")).agg(F.min("event_type").alias("text"))
    severity = F.when(n % 7 < 2, pick(("review", "blocking"), n)).otherwise("warning")
    findings = e.select(F.col("user_id").alias("plan_id"), (n % 5).cast("int").alias("bullet_index"), F.concat(F.lit("c"), (n % 4).cast("string")).alias("code"), severity.alias("severity"), F.col("event_type").alias("explanation"))
    return editing.with_findings(bullets, findings).select("plan_id", "bullet", "text", F.size("notes").alias("notes"), F.get("notes", F.lit(0)).alias("first"))


@query("""
SELECT doc_id AS plan_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END AS number, '# T' || chr(10) || chr(10) || '## A' || chr(10) || 'one' || chr(10) || chr(10) || '### Lipids' || chr(10) || chr(10) || '- a ' || lang || '[^' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END || ']' || chr(10) || '  <!-- p -->' || chr(10) || '- c[^' || CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END || ']' || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '[^2]: [S](http://s.org) 10.1/S' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || '[^3]: **Title:** [N](http://n.org)' || chr(10) END AS page, CAST(NULL AS VARCHAR) AS error FROM documents""")
def applied_targets(spark, d):
    """Pages with a plan's bullets under a heading, and one footnote for the source."""
    bullet = lambda t, comments: F.struct(t.alias("text"), F.lit("Lipids").alias("subsection"), comments.alias("comments"))
    none = F.array().cast("array<string>")
    bullets = F.array(bullet(F.concat(F.lit("a "), "lang"), F.array(F.lit("  <!-- p -->"))), bullet(F.lit("c"), none))
    plans = table(spark, d, "documents").select(_doc().alias("plan_id"), F.lit("# T\n\n## A\none\n\n## B\n\n[^2]: [S](http://s.org) 10.1/S\n").alias("page"), F.lit("## A").alias("heading"), F.lit("").alias("parent_heading"), F.when(_doc() % 2 == 0, "10.1/s").otherwise("").alias("doi"), F.lit("http://n.org").alias("url"), F.lit("[^#]: **Title:** [N](http://n.org)").alias("footnote"), bullets.alias("bullets"))
    return editing.apply_target(plans).select("plan_id", F.col("number").cast("int").alias("number"), "page", "error")


_LEADS = ("Citrus is a genus of trees that people grow in many warm countries of the world", "Citrus improves health", "The citrus fruits are effective in all", "")
_NEW_PAGE = [
    ("missing_new_article_title", "doc_id % 3 = 0"),
    ("invalid_new_article_tags", "doc_id % 5 = 0"),
    ("missing_new_article_entity_tag", "doc_id % 5 = 1"),
    ("missing_category_rationale", "doc_id % 7 = 0"),
    ("invalid_lead_kind", "kind = 'other'"),
    ("lead_not_definition_form", "lead NOT IN (1, 3)"),
    ("definition_lead_contains_health_claim", "lead = 3 AND kind = 'definition'"),
    ("lead_not_source_grounded", "lead = 3 AND kind = 'source_grounded'"),
]


@query(f"""
WITH p AS (SELECT doc_id, 1 + doc_id % 4 AS lead, {pick_sql(('definition', 'source_grounded', 'other'), 'doc_id // 4')} AS kind FROM documents)
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing_new_article_metadata' ELSE {joined(_NEW_PAGE)} END AS issues FROM p""")
def new_page_rules(spark, d):
    """What is wrong with pages that plans make."""
    n = _doc()
    tags = F.when(n % 5 == 0, F.array(F.lit("a"), F.lit(" "))).when(n % 5 == 1, F.array(F.lit("fruit"))).otherwise(F.array(F.lit("Citrus fruit")))
    lead = pick(_LEADS, n)
    page = F.struct(F.when(n % 3 == 0, " ").otherwise("T").alias("title"), tags.alias("tags"), pick(("definition", "source_grounded", "other"), F.floor(n / 4)).alias("lead_kind"), lead.alias("lead_text"), F.lit(_LEADS[0]).alias("lead_source_quote"), F.when(n % 7 == 0, "").otherwise("r").alias("category_rationale"))
    found = validate.new_page_issues(F.when(n % 11 != 0, page), F.lit("citrus"), F.lit("So: " + _LEADS[0] + "."))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))


_THESIS = "Citrus lowers lipids in rats that eat it every day"
_SUMMARY = [
    ("invalid_section_summary_text", "doc_id % 2 = 1"),
    ("section_summary_quote_not_in_source", "doc_id % 3 = 0"),
    ("section_summary_not_near_verbatim", "doc_id % 3 > 0 AND doc_id % 5 = 0"),
    ("section_summary_section_not_found", "doc_id % 7 = 0"),
    ("section_summary_entity_not_supported", "doc_id % 3 = 0 OR doc_id % 5 = 0"),
    ("section_summary_missing_species_scope", "doc_id % 5 = 0"),
]


@query(f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE {joined(_SUMMARY)} END AS issues FROM documents")
def summary_rules(spark, d):
    """What is wrong with theses above the bullets of a section."""
    n = _doc()
    said = F.concat(F.when(n % 5 == 0, "Something else altogether").otherwise(_THESIS), F.when(n % 2 == 1, " [^1]").otherwise(""))
    summary = F.struct(said.alias("text"), F.when(n % 3 == 0, "not in it").otherwise(_THESIS).alias("source_quote"), F.lit("Aim").alias("source_section"))
    found = validate.summary_issues(F.when(n % 11 != 0, summary), F.lit("Citrus"), F.lit(_THESIS + "."), n % 7 != 0, F.lit(True))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))


@query("""
SELECT doc_id, concat_ws(',', 'target_0_invalid_heading', CASE WHEN doc_id % 2 = 1 THEN 'target_0_bullet_0_entity_not_supported_by_passage' END, CASE WHEN doc_id % 3 = 0 THEN 'target_1_invalid_bullet_count' END) AS issues,
  concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'target_0_bullet_0_entity_not_supported_by_passage_waived_balance_qualifier' END, CASE WHEN doc_id % 3 > 0 THEN 'target_1_invalid_bullet_count_waived_balance_qualifier' END) AS warnings FROM documents""")
def waived_issues(spark, d):
    """Issues that a balancing quote excuses."""
    n = _doc()
    issues = F.array(*[F.lit(x) for x in ("target_0_invalid_heading", "target_0_bullet_0_entity_not_supported_by_passage", "target_1_invalid_bullet_count")])
    many = lambda k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.concat(F.lit("q"), i.cast("string")))
    targets = F.array(F.array(F.when(n % 2 == 0, "only in rats").otherwise("in mice")), F.when(n % 3 == 0, many(17)).otherwise(F.concat(many(8), F.array(F.lit("in rats"), F.lit("in rats")))))
    found = validate.waived(issues, targets, F.array(F.lit("in rats"), F.lit("")))
    return table(spark, d, "documents").select("doc_id", found.alias("x")).select("doc_id", F.array_join("x.issues", ",").alias("issues"), F.array_join("x.warnings", ",").alias("warnings"))


_BALANCE = [("balance_repair_added_unrelated_bullets", "doc_id % 5 = 0"), ("balance_repair_changed_targets", "doc_id % 3 = 0"), ("balance_repair_dropped_or_rewrote_bullet", "doc_id % 2 = 0"), ("balance_repair_qualifier_missing", "doc_id % 7 = 0")]


@query(f"SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'balance_repair_abandoned_plan' ELSE {joined(_BALANCE)} END AS issues FROM documents")
def balance_repairs(spark, d):
    """Whether second plans only add what reviews asked for."""
    n = _doc()
    bullet = lambda t, q: F.struct(t.alias("text"), q.alias("source_quote"))
    before = F.create_map(F.lit("a.md"), F.array(bullet(F.lit("one thing"), F.lit("q"))))
    own = [bullet(F.when(n % 2 == 0, "another").otherwise("one thing, but only in rats"), F.lit("q")), bullet(F.lit("so"), F.when(n % 7 == 0, "no").otherwise("but only in rats"))]
    more = F.when(n % 5 == 0, F.array(*own, own[1])).otherwise(F.array(*own))
    after = F.when(n % 3 == 0, F.create_map(F.lit("a.md"), more, F.lit("b.md"), F.array(own[1]))).otherwise(F.create_map(F.lit("a.md"), more))
    found = validate.balance_repair_issues(F.when(n % 11 == 0, "duplicate").otherwise("publish_changes"), before, after, F.array(F.lit("only in rats")))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))


_SOURCE = "Green tea lowered blood pressure in hypertensive rats over eight weeks"
_RULES = sorted(
    [
        ("study_type_mismatch", "doc_id % 13 = 0"),
        ("target_0_not_in_candidates", "doc_id % 2 = 1"),
        ("target_0_invalid_heading", "doc_id % 3 = 0"),
        ("target_0_entity_mismatch", "doc_id % 2 = 1"),
        ("target_0_missing_rationale", "doc_id % 5 = 0"),
        ("target_0_bullet_0_quote_not_in_source", "doc_id % 7 = 0"),
        ("target_0_bullet_0_not_near_verbatim", "doc_id % 7 > 0 AND doc_id % 4 = 0"),
        ("target_0_bullet_0_invalid_claim_kind", "doc_id % 6 = 0"),
        ("target_0_bullet_0_source_finding_scope_must_be_animal", "doc_id % 6 > 0 AND doc_id % 8 = 0"),
        ("target_0_bullet_0_entity_not_supported_by_passage", "doc_id % 7 = 0 OR doc_id % 4 = 0"),
        ("target_0_bullet_0_external_reference_not_allowed", "doc_id % 9 = 0"),
        ("target_0_bullet_0_source_section_not_found", "doc_id % 10 = 0"),
    ]
)


@query(f"SELECT doc_id AS plan_id, CASE WHEN doc_id % 11 = 0 THEN 'invalid_decision' ELSE {joined(_RULES)} END AS issues FROM documents")
def plan_rules(spark, d):
    """What is wrong with edit plans."""
    n = _doc()
    docs = table(spark, d, "documents")
    bullet = F.struct(F.when(n % 4 == 0, "Nothing of the sort was said").otherwise(_SOURCE + ".").alias("text"), F.when(n % 7 == 0, "Something that no source of any kind says").otherwise(_SOURCE).alias("source_quote"), F.when(n % 10 == 0, "Nowhere").otherwise("Results").alias("source_section"), F.when(n % 6 == 0, "guess").otherwise("source_finding").alias("claim_kind"), F.when(n % 8 == 0, "human").otherwise("animal").alias("evidence_scope"), F.lit("").alias("subsection"), F.when(n % 9 == 0, 1).otherwise(0).alias("n_references"))
    target = F.struct(F.lit("append_existing").alias("operation"), F.when(n % 2 == 1, "en/none.md").otherwise("en/green-tea.md").alias("target_path"), F.lit("Green tea").alias("target_entity"), F.when(n % 3 == 0, "Blood").otherwise("## Blood").alias("heading"), F.lit("").alias("parent_heading"), F.when(n % 5 == 0, "").otherwise("r").alias("rationale"), F.lit(None).cast("string").alias("title"), F.array(bullet).alias("bullets"))
    plans = docs.select(n.alias("plan_id"), n.alias("packet_id"), F.when(n % 11 == 0, "maybe").otherwise("publish_changes").alias("decision"), F.when(n % 13 == 0, "Review").otherwise("Animal Study").alias("study_type"), F.array(target).alias("targets"))
    plans = plans.withColumn("targets", F.when(n_is(11), F.array().cast(plans.schema["targets"].dataType)).otherwise(F.col("targets")))
    source = docs.select(n.alias("packet_id"), F.lit("Green tea in rats").alias("title"), F.lit("").alias("abstract"), F.lit(f"## Results\n{_SOURCE}.\n").alias("body_markdown"), F.lit("Animal Study").alias("study_type"), F.lit("").alias("keywords"))
    pages = spark.createDataFrame([("en/green-tea.md", "Green Tea"), ("en/none.txt", "X")], "path string, title string")
    return validate.validate(plans, source, pages, "en").select("plan_id", F.array_join("issues", ",").alias("issues"))


def n_is(k: int):
    """Whether the plan's number is a multiple."""
    return F.col("plan_id") % k == 0


_CLEANED = ("Green tea lowered blood pressure in hypertensive rats over eight weeks [3].", "Coffee is best", "- no bullet")


@query("""
SELECT doc_id, doc_id % 4 < 3 AS kept, CASE WHEN doc_id % 4 = 3 THEN 'dropped_unprovable_bullet' ELSE concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'removed_external_reference_fields' END, CASE WHEN doc_id % 2 = 0 THEN 'added_property_subsection' END, CASE WHEN doc_id % 3 > 0 THEN 'replaced_text_with_source_quote' ELSE 'removed_publisher_markers' END) END AS actions,
  CASE WHEN doc_id % 4 < 3 AND doc_id % 2 = 0 THEN 'Blood Pressure' ELSE '' END AS subsection FROM documents""")
def cleaned_bullets(spark, d):
    """Bullets after the bounded clean-up, with its log."""
    n = _doc()
    quote = F.when(n % 4 == 3, "Nothing that is in it at all, whatever").otherwise(_CLEANED[0])
    df = table(spark, d, "documents").select("doc_id", F.when(n % 2 == 0, "## Healing Properties").otherwise("## Other").alias("heading"), pick(_CLEANED, n).alias("text"), quote.alias("source_quote"), F.lit("").alias("subsection"), F.lit("source_finding").alias("claim_kind"), F.when(n % 5 == 0, 2).otherwise(0).alias("n_references"), F.lit("Intro. " + _CLEANED[0] + " End.").alias("evidence"))
    found = normalize.bullets(df)
    return found.select("doc_id", "kept", F.array_join("actions", ",").alias("actions"), F.when(F.col("kept"), F.col("subsection")).otherwise("").alias("subsection"))


@query(f"""
WITH c AS (SELECT conv_id, turn, {_key('text')} AS k FROM conversations)
SELECT conv_id, turn, len(list_filter(string_split(k, ' '), lambda w: w <> '')) AS n_words, length(k) AS n_chars FROM c""")
def turn_sizes(spark, d):
    """Words and characters of normalized turns."""
    k = text.key("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(text.words(k)).cast("long").alias("n_words"), F.length(k).cast("long").alias("n_chars"))


_MODES = ("full", "truncated", "omit")


@query("""
WITH c AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents),
m AS (SELECT *, unnest(['full', 'truncated', 'omit']) AS mode FROM c), a AS (SELECT *, CASE mode WHEN 'omit' THEN '' WHEN 'truncated' THEN CASE WHEN length(t) > 500 THEN regexp_replace(regexp_replace(substr(t, 1, 500), ' [^ ]*$', ''), '[ ,;:.]+$', '') || ' […]' ELSE t END ELSE t END AS abstract,
  CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'http://r.org/' || doc_id END AS page, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id ELSE 'http://r.org/' || doc_id END ELSE 'http://u.org/' || doc_id END AS src FROM m)
SELECT doc_id, mode, md5(concat_ws(chr(10), '[^' || doc_id || ']: **Title:** [T ' || lang || '](' || page || ')<br>', '**Publication:** [' || CASE WHEN doc_id % 5 = 0 THEN 'Source' ELSE source END || '](' || src || ')<br>', '**Date:** Unknown<br>', '**Study Type:** Research Article<br>', '**Author(s):** A. B.<br>', CASE WHEN doc_id % 7 = 0 THEN '**Institution(s):** I<br>' END,
  CASE WHEN abstract <> '' THEN '**Abstract:** ' || abstract || '<br>' END, CASE WHEN doc_id % 4 = 0 THEN '**Copy:** [archive](x), [archive-mirror](y), [archive-3](z)<br>' END, CASE WHEN doc_id % 2 = 0 THEN '**DOI:** [10.1/' || doc_id || '](https://doi.org/10.1/' || doc_id || ')<br>' END, '**Source URL:** [' || src || '](' || src || ')')) AS block FROM a""")
def reference_blocks(spark, d):
    """Whole footnotes of sources, with abstracts in three ways."""
    from .sources import writers

    n = _doc()
    s = n.cast("string")
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit(" T  "), "lang").alias("title"), F.when(n % 2 == 0, F.concat(F.lit("10.1/"), s)).otherwise("").alias("doi"), F.concat(F.lit("http://r.org/"), s).alias("reference_url"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("http://u.org/"), s)).alias("url"), F.when(n % 5 == 0, "").otherwise(F.col("source")).alias("journal"), F.lit("").alias("pub_date"), F.lit(None).cast("string").alias("study_type"), F.lit("A. B.").alias("authors"), F.when(n % 7 == 0, " I").otherwise("").alias("institutions"), F.col("text").alias("abstract"), F.when(n % 4 == 0, F.array(*map(F.lit, "xyz"))).alias("archives"),
    )
    out = None
    for mode in _MODES:
        df = docs.select("doc_id", F.lit(mode).alias("mode"), F.md5(writers.reference_block(n, mode).cast("binary")).alias("block"))
        out = df if out is None else out.unionAll(df)
    return out


_SAID = "'`' || s || '` `c' || (event_id % 4) || '`' || CASE WHEN event_id % 2 = 0 THEN ' (bullet ' || (event_id % 3) || ')' ELSE '' END || ': ' || CASE WHEN event_id % 5 = 0 THEN 'No explanation supplied.' ELSE 'a \\`' || event_type || '\\` b' END"


@query(f"""
WITH e AS (SELECT user_id, event_id, event_id % 4 = 1 AS bad, (['review', 'blocking'])[1 + event_id % 2] AS s, event_type FROM events), l AS (SELECT user_id, event_id, bad, {_SAID} AS said FROM e),
g AS (SELECT user_id, string_agg('- ' || said, chr(10) ORDER BY event_id) FILTER (NOT bad) AS good, string_agg('- `evidence` ' || said || ' Validation errors: `x`, `y`.', chr(10) ORDER BY event_id) FILTER (bad) AS refused FROM l GROUP BY 1)
SELECT user_id AS review_id, md5('### Validated critic findings' || chr(10) || chr(10) || coalesce(good, '- None') || chr(10) || chr(10) || '### Rejected critic observations (non-blocking)' || chr(10) || chr(10) || 'These observations failed critic-evidence validation and did not affect the publication gate decision.' || chr(10) || chr(10) || coalesce(refused, '- None')) AS audit FROM g""")
def review_audits(spark, d):
    """Reviews as Markdown: what counts, and what was refused."""
    from .sources import writers

    e = F.col("event_id")
    issues = table(spark, d, "events").select(F.col("user_id").alias("review_id"), e.alias("n"), F.lit("evidence").alias("kind"), F.concat(F.lit("c"), (e % 4).cast("string")).alias("code"), pick(("review", "blocking"), e).alias("severity"), F.when(e % 2 == 0, (e % 3).cast("int")).alias("bullet_index"), F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("a  `"), "event_type", F.lit("`\n b"))).alias("explanation"), F.when(e % 4 == 1, F.array(F.lit("x"), F.lit("y"))).alias("errors"))
    return writers.review_audit(issues).withColumn("audit", F.md5(F.col("audit").cast("binary")))


@query("""
SELECT doc_id::VARCHAR AS article_key, '{"generated_at":"2024-02-01 00:00:00Z","article_key":"' || doc_id || '","title":"T ' || lang || '","matches":[' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '{"rank":1,"path":"a/' || source || '.md","score":50.5},{"rank":2,"path":"b.md","score":30.0}' END || ']}' AS record FROM documents""")
def queue_records(spark, d):
    """Articles of a search as JSON records with their matches."""
    from .sources import writers

    docs = table(spark, d, "documents")
    articles = docs.select(_doc().cast("string").alias("article_key"), F.concat(F.lit("T "), "lang").alias("title"))
    some = docs.where("doc_id % 3 > 0")
    match = lambda rank, path, score: some.select(_doc().cast("string").alias("article_key"), F.lit(rank).alias("rank"), path.alias("path"), F.lit(score).alias("score"))
    matches = match(2, F.lit("b.md"), 30.0).unionAll(match(1, F.concat(F.lit("a/"), "source", F.lit(".md")), 50.5))
    return writers.queue_records(articles, matches, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("""
SELECT doc_id AS plan_id, '| Target | Bullet | Scope | Entity | Exact quote | Near-verbatim |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || '| `tea.md` | 0 | animal | ✓ | ' || CASE WHEN doc_id % 2 = 0 THEN '✓' ELSE '✗' END || ' | 1.00 |' || chr(10) || '| `tea.md` | 1 | — | ✗ | ✓ | 0.00 |' AS "table" FROM documents""")
def gate_tables(spark, d):
    """What speaks for each bullet of a plan, as a table."""
    n = _doc()
    bullet = lambda t, q, scope: F.struct(t.alias("text"), q.alias("source_quote"), F.lit("Results").alias("source_section"), F.lit("source_finding").alias("claim_kind"), F.lit(scope).cast("string").alias("evidence_scope"), F.lit("").alias("subsection"), F.lit(0).alias("n_references"))
    same = F.when(n % 2 == 0, "Green tea lowered it").otherwise("Green tea did nothing")
    target = F.struct(F.lit("append_existing").alias("operation"), F.lit("en/tea.md").alias("target_path"), F.lit("Green tea").alias("target_entity"), F.lit("## A").alias("heading"), F.lit("").alias("parent_heading"), F.lit("r").alias("rationale"), F.lit(None).cast("string").alias("title"), F.array(bullet(same, same, "animal"), bullet(F.lit("Other words"), F.lit("In rats"), None)).alias("bullets"))
    docs = table(spark, d, "documents")
    plans = docs.select(n.alias("plan_id"), n.alias("packet_id"), F.lit("publish_changes").alias("decision"), F.lit("").alias("study_type"), F.array(target).alias("targets"))
    source = docs.select(n.alias("packet_id"), F.lit("T").alias("title"), F.lit("").alias("abstract"), F.lit("Green tea lowered it. In rats.").alias("body_markdown"), F.lit("").alias("keywords"))
    return validate.gate_table(validate.bullet_evidence(plans, source))


@query("""
WITH a AS (SELECT (event_id * 7 % 1500)::VARCHAR AS article_key, 'http://s.org/' || (event_id % 2000) AS source_url, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'c' || (event_id % 50) END AS canonical_source_url FROM events WHERE event_type <> 'error'),
u AS (SELECT 'article_key' AS name, article_key AS value FROM a UNION ALL SELECT 'source_url', source_url FROM a UNION ALL SELECT 'canonical_source_url', canonical_source_url FROM a WHERE canonical_source_url <> '')
SELECT name, value, count(*) AS active FROM u GROUP BY ALL HAVING count(*) > 1""")
def job_breaches(spark, d):
    """Keys and urls that more than one active job has."""
    from .operators import jobs

    e = F.col("event_id")
    t = table(spark, d, "events").select((e * 7 % 1500).cast("string").alias("article_key"), F.concat(F.lit("http://s.org/"), (e % 2000).cast("string")).alias("source_url"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("c"), (e % 50).cast("string"))).alias("canonical_source_url"), F.when(F.col("event_type") == "error", "failed").otherwise("queued").alias("state"))
    return jobs.breaches(t)


_PASSAGE = "Citrus is grown widely [4] and eaten (Miller, 2020)."
_LISTED = "4. Smith J. Citrus. Miller A. On eating, 2020. http://m.org/1"
_OLDER = [
    ("source_finding_has_background_reference", "kind = 'source_finding' AND n > 0"),
    ("missing_cited_reference_provenance", "kind = 'background_fact' AND n < 2"),
    ("citation_marker_not_in_passage", "kind = 'background_fact' AND n = 3"),
    ("cited_reference_not_in_source", "n = 3"),
    ("cited_reference_marker_mismatch", "n = 1"),
    ("cited_reference_url_not_in_source", "n = 2"),
]
_EXCLUDED = [("exclusion_0_quote_not_in_source", "doc_id % 2 = 0"), ("exclusion_0_missing_reason", "doc_id % 3 = 0"), ("exclusion_1_missing_reason", "true")]


@query(f"""
WITH r AS (SELECT doc_id, {pick_sql(('background_fact', 'source_finding'), 'doc_id')} AS kind, (doc_id // 2) % 4 AS n FROM documents)
SELECT doc_id, {joined(_OLDER)} AS "references", CASE WHEN doc_id % 5 = 0 THEN 'invalid_exclusions' ELSE {joined(_EXCLUDED)} END AS exclusions,
  CASE doc_id % 4 WHEN 0 THEN 'formulation_definition_missing' WHEN 1 THEN 'formulation_definition_not_one_line,formulation_definition_quote_not_in_source' WHEN 2 THEN 'formulation_definition_not_near_verbatim' ELSE '' END AS formulation, 'invalid_heading,bullet_1_x,target_1_y' AS older FROM r""")
def older_plan_rules(spark, d):
    """The rules that only the older form of plans has."""
    n = _doc()
    k = F.floor(n / 2) % 4
    ref = lambda marker, text_, url: F.struct(F.lit(marker).alias("citation_marker"), F.lit(text_).alias("reference_text"), F.lit(url).alias("reference_url"))
    smith, miller = ref("[4]", "4. Smith J. Citrus.", ""), ref("(Miller, 2020)", "Miller A. On eating, 2020.", "http://none.org")
    refs = F.when(k == 0, F.array().cast(validate.REFERENCES)).when(k == 1, F.array(ref("[4]", "Miller A. On eating, 2020.", "http://m.org/1"))).when(k == 2, F.array(smith, miller)).otherwise(F.array(smith, miller.withField("reference_url", F.lit("")), ref("[5]", "Nobody", "")))
    evidence = F.lit(f"{_PASSAGE}\n{_LISTED}")
    out = F.when(n % 5 > 0, F.array(F.struct(F.when(n % 2 == 0, "not in it").otherwise("grown widely").alias("source_quote"), F.when(n % 3 == 0, " ").otherwise("r").alias("reason")), F.struct(F.lit("").alias("source_quote"), F.lit("").alias("reason"))))
    whole = "The extract was a blend of citrus peel and water that was given daily"
    said = F.struct(F.when(n % 4 == 1, "a\nb").when(n % 4 == 2, "Something else").otherwise(whole).alias("text"), F.when(n % 4 == 1, "short").otherwise(whole).alias("source_quote"))
    bullets = F.array(F.struct(F.lit("The extracts helped").alias("text"), F.lit("In vivo").alias("evidence_scope")))
    made = validate.formulation_issues(F.when(n % 4 > 0, said), bullets, F.lit(whole + "."))
    older = validate.older_names(F.array(F.lit("target_0_invalid_heading"), F.lit("target_0_bullet_1_x"), F.lit("target_1_y")))
    join = lambda x: F.array_join(x, ",")
    return table(spark, d, "documents").select("doc_id", join(validate.cited_reference_issues(pick(("background_fact", "source_finding"), n), F.lit(_PASSAGE), refs, evidence)).alias("references"), join(validate.exclusion_issues(out, evidence)).alias("exclusions"), join(made).alias("formulation"), join(older).alias("older"))


def _block_sql(p: str) -> str:
    page, src = f"CASE WHEN {p}.doi <> '' THEN 'https://doi.org/' || {p}.doi ELSE {p}.url END", f"{p}.url"
    return f"concat_ws(chr(10), ' **Title:** [' || {p}.title || '](' || {page} || ')<br>', '**Publication:** [Source](' || {src} || ')<br>', '**Date:** Unknown<br>', '**Study Type:** Research Article<br>', '**Author(s):** Unknown<br>', CASE WHEN {p}.doi <> '' THEN '**DOI:** [' || {p}.doi || '](https://doi.org/' || {p}.doi || ')<br>' END, '**Source URL:** [' || {src} || '](' || {src} || ')')"


@query(f"""
WITH s AS (SELECT page_id, {_TITLE} AS t, trim(coalesce(url, '')) AS url, CASE WHEN length(html) % 2 = 0 THEN '10.5555/' || length(html) || '.' || page_id ELSE '' END AS doi FROM pages),
p AS (SELECT page_id, CASE WHEN t = '' THEN 'Untitled Source' ELSE t END AS title, url, doi FROM s),
n AS (SELECT a.page_id, a.url, a.doi, lower({_block_sql('a')}) AS own, lower({_block_sql('b')}) AS other FROM p a JOIN p b ON b.page_id = a.page_id + 1),
q AS (SELECT page_id, own, other, unnest([{{'asked': 'both', 'doi': doi, 'url': url}}, {{'asked': 'url', 'doi': '', 'url': upper(url) || '//'}}, {{'asked': 'other doi', 'doi': '10.5555/none', 'url': url}}, {{'asked': 'none', 'doi': '', 'url': ''}}]) AS x FROM n),
k AS (SELECT *, CASE WHEN x.doi <> '' THEN lower(x.doi) ELSE regexp_replace(lower(x.url), '/+$', '') END AS sought FROM q)
SELECT page_id, x.asked AS asked, CASE WHEN sought <> '' AND contains(other, sought) THEN 4 WHEN sought <> '' AND contains(own, sought) THEN 7 ELSE 8 END AS number FROM k""")
def shared_footnotes(spark, d):
    """Pages with two sources' whole footnotes: the number that a source has there by its DOI or url, or the next free one."""
    from .sources import writers

    s = table(spark, d, "pages").select("page_id", _title().alias("title"), F.trim(F.coalesce("url", F.lit(""))).alias("url"), F.when(F.length("html") % 2 == 0, F.concat(F.lit("10.5555/"), F.length("html").cast("string"), F.lit("."), F.col("page_id").cast("string"))).otherwise("").alias("doi"))
    none = {c: F.lit("") for c in ("reference_url", "journal", "pub_date", "study_type", "authors", "institutions", "abstract")} | {"archives": F.array().cast("array<string>")}
    of = lambda n: s.withColumns(none).select("page_id", "url", "doi", writers.reference_block(F.lit(n)).alias("block"))
    other = of(4).select((F.col("page_id") - 1).alias("page_id"), F.col("block").alias("first"))
    page = of(7).join(other, "page_id").withColumn("page", F.concat_ws("\n\n", F.lit("# A"), "first", "block"))
    ask = lambda asked, doi, url: F.struct(F.lit(asked).alias("asked"), doi.alias("doi"), url.alias("url"))
    asks = F.array(ask("both", F.col("doi"), F.col("url")), ask("url", F.lit(""), F.concat(F.upper("url"), F.lit("//"))), ask("other doi", F.lit("10.5555/none"), F.col("url")), ask("none", F.lit(""), F.lit("")))
    q = page.select("page_id", "page", F.explode(asks).alias("x"))
    return q.select("page_id", "x.asked", editing.shared_reference(F.col("page"), F.col("x.doi"), F.col("x.url")).alias("number"))


_DOI_IN = lambda x: f"regexp_replace(regexp_extract({x}, '(?i)\\b10\\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+\\b', 0), '[).,;]+$', '')"
_BLANK = {c: f"({_key(c)} = '' OR {_key(c)} IN ({', '.join(quoted(x) for x in xs)}))" for c, xs in survivorship.PLACEHOLDERS.items()}
_WORDS = lambda x: f"list_distinct(list_filter(string_split({_key(x)}, ' '), lambda w: w <> ''))"


@query(f"""
WITH t AS (SELECT doc_id, n_chars, source, lang, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id AS packet_id, trim(substr(t, 1, 60)) AS title, CASE n_chars % 5 WHEN 0 THEN 'Authors' WHEN 1 THEN '' WHEN 2 THEN trim(substr(t, 1, 1500)) ELSE split_part(t, ' ', 1) END AS authors, CASE WHEN lang = 'en' THEN 'Unknown' WHEN n_chars % 2 = 0 THEN '' ELSE source END AS journal, CASE WHEN n_chars % 3 = 0 THEN 'published' ELSE '2020-0' || (n_chars % 9) END AS pub_date,
    trim(CASE n_chars % 4 WHEN 0 THEN '' WHEN 1 THEN substr(t, 1, 100) || '...' WHEN 2 THEN substr(t, 1, 80) ELSE substr(t, 1, 400) END) AS abstract, CASE n_chars % 4 WHEN 0 THEN 'DOI: 10.5555/' || n_chars || '.' WHEN 1 THEN '10.5555/' || n_chars ELSE '' END AS doi,
    CASE WHEN n_chars % 7 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/' || n_chars ELSE 'https://x.org/' || n_chars END AS url, CASE WHEN n_chars % 3 = 1 THEN 'https://y.org/10.6666/r' || n_chars ELSE '' END AS requested_url, substr(t, 1, n_chars % 900) || ' see 10.7777/b' || n_chars || ' there ' || t AS body FROM t),
r AS (SELECT doc_id - 1 AS packet_id, CASE WHEN n_chars % 2 = 0 THEN trim(substr(t, 1, 50)) ELSE '' END AS title, CASE WHEN n_chars % 3 = 0 THEN '10.8888/' || n_chars || ',' ELSE '' END AS doi, CASE WHEN n_chars % 4 < 2 THEN trim(substr(t, 1, 12)) ELSE '' END AS authors, CASE WHEN n_chars % 2 = 1 THEN source ELSE '' END AS journal, CASE WHEN n_chars % 5 < 3 THEN '2021' ELSE '' END AS pub_date, trim(substr(t, 1, 300)) AS abstract FROM t WHERE n_chars % 6 > 0),
m AS (SELECT doc_id - 2 AS packet_id, trim(substr(t, 1, 40)) AS title, '10.9999/' || n_chars AS doi, trim(substr(t, 1, 9)) AS authors, 'pub ' || source AS journal, '2022' AS pub_date, n_chars::VARCHAR AS pmid FROM t WHERE n_chars % 5 > 0),
u AS (SELECT doc_id AS packet_id, quality = 1 AS is_open, CASE WHEN toxic = 0 THEN 'https://oa.org/' || doc_id ELSE '' END AS best FROM labels),
d AS (SELECT *, coalesce(nullif({_DOI_IN('doi')}, ''), nullif({_DOI_IN('url')}, ''), nullif({_DOI_IN('requested_url')}, ''), {_DOI_IN('substr(body, 1, 5000)')}) AS own_doi, CASE WHEN {_BLANK['authors']} THEN '' ELSE authors END AS a0, CASE WHEN {_BLANK['journal']} THEN '' ELSE journal END AS j0, CASE WHEN {_BLANK['pub_date']} THEN '' ELSE pub_date END AS d0 FROM p),
x AS (SELECT d.*, coalesce(r.title, '') AS rt, coalesce({_DOI_IN('r.doi')}, '') AS rd, coalesce(r.authors, '') AS ra, coalesce(r.journal, '') AS rj, coalesce(r.pub_date, '') AS rp, coalesce(r.abstract, '') AS rb, coalesce(m.title, '') AS mt, coalesce(m.doi, '') AS md, coalesce(m.authors, '') AS ma, coalesce(m.journal, '') AS mj, coalesce(m.pub_date, '') AS mp,
    coalesce(m.pmid, '') AS pmid, r.packet_id IS NOT NULL AS has_r, m.packet_id IS NOT NULL AS has_m, u.packet_id IS NOT NULL AS has_u, coalesce(u.is_open, false) OR contains(url, 'pmc.ncbi.nlm.nih.gov') AS is_open_access, coalesce(u.best, '') AS best_open_access_url FROM d LEFT JOIN r USING (packet_id) LEFT JOIN m USING (packet_id) LEFT JOIN u USING (packet_id)),
y AS (SELECT *, coalesce(nullif(a0, ''), nullif(ra, ''), ma) AS a1, coalesce(nullif(ra, ''), ma) AS ax, CASE WHEN abstract = '' THEN rb ELSE abstract END AS b1, {_WORDS('title')} AS w1, {_WORDS('rt')} AS w2, {_key('title')} = {_key('rt')} AS same FROM x),
z AS (SELECT *, ax <> '' AND (length(a1) > 1200 OR regexp_matches(lower(a1), 'highlights •|abstract quercetin|author links open overlay')) AS dirty, rb <> '' AND (ends_with(b1, '...') OR ends_with(b1, '…') OR (length(b1) < 120 AND length(rb) > length(b1))) AS short,
    CASE WHEN own_doi <> '' AND title <> '' AND rt <> '' THEN CASE WHEN len(w1) = 0 OR len(w2) = 0 THEN 0.0 WHEN same THEN 1.0 ELSE round(len(list_intersect(w1, w2)) / greatest(len(w1), len(w2)), 4) END END AS score FROM y)
SELECT packet_id, coalesce(nullif(title, ''), nullif(rt, ''), mt) AS title, coalesce(nullif(own_doi, ''), nullif(rd, ''), md) AS doi, CASE WHEN dirty THEN ax ELSE a1 END AS authors, coalesce(nullif(j0, ''), nullif(rj, ''), mj) AS journal, coalesce(nullif(d0, ''), nullif(rp, ''), mp) AS pub_date, CASE WHEN short THEN rb ELSE b1 END AS abstract,
  concat_ws(',', CASE WHEN doi <> own_doi THEN 'doi:discarded_placeholder_or_normalized' END, CASE WHEN authors <> '' AND a0 = '' THEN 'authors:discarded_placeholder' END, CASE WHEN journal <> '' AND j0 = '' THEN 'journal:discarded_placeholder' END, CASE WHEN pub_date <> '' AND d0 = '' THEN 'pub_date:discarded_placeholder' END,
    CASE WHEN own_doi = '' AND rd <> '' THEN 'doi:recovered_from_crossref' WHEN own_doi = '' AND md <> '' THEN 'doi:recovered_from_pubmed' END, CASE WHEN title = '' AND rt <> '' THEN 'title:recovered_from_crossref' WHEN title = '' AND mt <> '' THEN 'title:recovered_from_pubmed' END, CASE WHEN a0 = '' AND ra <> '' THEN 'authors:recovered_from_crossref' WHEN a0 = '' AND ma <> '' THEN 'authors:recovered_from_pubmed' END,
    CASE WHEN dirty THEN 'authors:replaced_polluted_from_external_metadata' END, CASE WHEN j0 = '' AND rj <> '' THEN 'journal:recovered_from_crossref' WHEN j0 = '' AND mj <> '' THEN 'journal:recovered_from_pubmed' END, CASE WHEN d0 = '' AND rp <> '' THEN 'pub_date:recovered_from_crossref' WHEN d0 = '' AND mp <> '' THEN 'pub_date:recovered_from_pubmed' END, CASE WHEN rb <> '' AND (abstract = '' OR short) THEN 'abstract:recovered_from_crossref' END) AS repairs,
  score AS doi_title_score, coalesce(score < 0.75, false) AS mismatch, concat_ws(',', CASE WHEN has_r THEN 'crossref' END, CASE WHEN has_m THEN 'pubmed' END, CASE WHEN has_u THEN 'unpaywall' END) AS enrichment_sources, pmid, is_open_access, best_open_access_url FROM z""")
def survived_metadata(spark, d):
    """Documents as packets with gaps, placeholders and other texts' pieces in them, repaired from three registries."""
    n = F.col("n_chars")
    s = n.cast("string")
    t = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("t"))
    head = lambda k: F.trim(F.substring("t", 1, k))
    p = t.select(
        F.col("doc_id").alias("packet_id"), head(60).alias("title"), F.when(n % 5 == 0, "Authors").when(n % 5 == 1, "").when(n % 5 == 2, head(1500)).otherwise(F.substring_index("t", " ", 1)).alias("authors"), F.when(F.col("lang") == "en", "Unknown").when(n % 2 == 0, "").otherwise(F.col("source")).alias("journal"), F.when(n % 3 == 0, "published").otherwise(F.concat(F.lit("2020-0"), (n % 9).cast("string"))).alias("pub_date"),
        F.trim(F.when(n % 4 == 0, "").when(n % 4 == 1, F.concat(F.substring("t", 1, 100), F.lit("..."))).when(n % 4 == 2, F.substring("t", 1, 80)).otherwise(F.substring("t", 1, 400))).alias("abstract"), F.when(n % 4 == 0, F.concat(F.lit("DOI: 10.5555/"), s, F.lit("."))).when(n % 4 == 1, F.concat(F.lit("10.5555/"), s)).otherwise("").alias("doi"),
        F.concat(F.when(n % 7 == 0, "https://pmc.ncbi.nlm.nih.gov/").otherwise("https://x.org/"), s).alias("url"), F.when(n % 3 == 1, F.concat(F.lit("https://y.org/10.6666/r"), s)).otherwise("").alias("requested_url"), F.concat(F.expr("substr(t, 1, int(n_chars % 900))"), F.lit(" see 10.7777/b"), s, F.lit(" there "), "t").alias("body_markdown"),
    )
    part = lambda test, x: F.when(test, x).otherwise("")
    crossref = t.where(n % 6 > 0).select((F.col("doc_id") - 1).alias("packet_id"), part(n % 2 == 0, head(50)).alias("title"), part(n % 3 == 0, F.concat(F.lit("10.8888/"), s, F.lit(","))).alias("doi"), part(n % 4 < 2, head(12)).alias("authors"), part(n % 2 == 1, F.col("source")).alias("journal"), part(n % 5 < 3, F.lit("2021")).alias("pub_date"), head(300).alias("abstract"))
    pubmed = t.where(n % 5 > 0).select((F.col("doc_id") - 2).alias("packet_id"), head(40).alias("title"), F.concat(F.lit("10.9999/"), s).alias("doi"), head(9).alias("authors"), F.concat(F.lit("pub "), "source").alias("journal"), F.lit("2022").alias("pub_date"), s.alias("pmid"))
    unpaywall = table(spark, d, "labels").select(F.col("doc_id").alias("packet_id"), (F.col("quality") == 1).alias("is_open_access"), part(F.col("toxic") == 0, F.concat(F.lit("https://oa.org/"), F.col("doc_id").cast("string"))).alias("best_open_access_url"))
    found = packets.survive(p, crossref, pubmed, unpaywall)
    return found.withColumns({"repairs": F.array_join("repairs", ","), "mismatch": F.size("consistency") > 0, "enrichment_sources": F.array_join("enrichment_sources", ",")}).drop("consistency")


_IDEA = lambda n: f"trim(regexp_replace(split_part(t, '. ', {n}), '[^A-Za-z ]+', '', 'g'))"
_LONG = lambda x: f"len(list_filter(string_split({_key(x)}, ' '), lambda w: w <> '')) >= 4"
_NOTE = "'  <!-- provenance | claim_kind: source_finding | source_section: ' || lang || ' | source_quote: ' || {0} || ' | cited_references: none -->'"


@query(f"""
WITH t AS (SELECT doc_id, n_chars AS n, lang, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), s AS (SELECT *, {_IDEA(1)} AS a, {_IDEA(2)} AS b, {_IDEA(3)} AS c FROM t),
r AS (SELECT *, b || '. ' || c AS two, 'Sum of ' || source AS sum, {_NOTE.format('a')} AS pa, {_NOTE.format('b')} AS pb FROM s),
p AS (SELECT *, '---' || chr(10) || 'title: ' || CASE WHEN n % 13 = 0 THEN 'x' ELSE 'T' END || chr(10) || '---' || chr(10) || '# T' || chr(10) || chr(10) || '## Uses' || chr(10) || CASE WHEN n % 5 = 0 THEN chr(10) || '- ' || a || '[^1]' || chr(10) ELSE '' END || CASE WHEN n % 3 > 0 THEN chr(10) || sum || '[^1]' || chr(10) ELSE '' END || chr(10) || '### Lipids' || chr(10) || chr(10) || '- ' || a || '[^1]' || chr(10) || pa || chr(10) || '- ' || two || CASE WHEN n % 2 = 0 THEN '[^1]' ELSE '' END || chr(10)
   || CASE WHEN n % 7 < 4 THEN pb || chr(10) ELSE '' END || CASE WHEN n % 3 = 0 AND n % 2 = 0 THEN chr(10) || sum || '[^1]' || chr(10) ELSE '' END || CASE WHEN n % 4 = 0 THEN '  <!-- critic | severity: blocking | code: c1 | explanation: ' || lang || ' -->' || chr(10) ELSE '' END || CASE WHEN n % 11 = 0 THEN 'See [it](#uses) and [that](#' || source || ').' || chr(10) ELSE '' END
   || chr(10) || '[^1]: Source **DOI:** 10.5555/' || CASE WHEN n % 17 = 0 THEN '' ELSE n::VARCHAR END || chr(10) || CASE WHEN n % 19 = 0 THEN '[^2]: 10.5555/' || n || ' again' || chr(10) ELSE '' END AS after FROM r),
x AS (SELECT *, strpos(after, chr(10) || '## Uses' || chr(10)) AS u, strpos(after, chr(10) || '### Lipids') AS h FROM p)
SELECT doc_id, {joined([
    ("animal_bullet_missing_species_scope", "lang = 'fr' AND NOT regexp_matches(a, '(?i)\\b(rats?|mice|mouse|murine|rodents?|rabbits?|piglets?|zebrafish|in vivo|animals?)\\b')"),
    ("bullet_0_critic_annotation_missing", "NOT contains(after, '  <!-- critic | severity: blocking | code: c1 | explanation: ' || lang || ' -->')"),
    ("bullet_1_citation_missing", "NOT contains(after, '- ' || two || '[^1]')"),
    ("bullet_1_provenance_missing", "NOT contains(after, pb)"),
    ("bullet_not_single_idea", f"{_LONG('b')} AND {_LONG('c')} AND regexp_matches(c, '^[A-Z]') AND NOT regexp_matches(b, '\\b(vs|al|approx|ca|cf|etc|Fig)$')"),
    ("bullet_outside_property_subsection", "contains(substr(after, 1, h), chr(10) || '- ')"),
])} AS bullets, {joined([
    ("dead_anchor_link", "contains(after, '](#' || source || ')')"),
    ("doi_missing_from_reference", "NOT contains(after, '10.5555/' || n)"),
    ("duplicate_source_footnote", "len(regexp_extract_all(split_part(after, chr(10) || '[^1]:', 2), '10\\.5555/' || n)) > 1"),
    ("frontmatter_changed", "n % 13 = 0"),
    ("section_summary_citation_missing", "NOT contains(after, sum || '[^1]')"),
    ("section_summary_missing_or_misplaced", "NOT contains(after, sum) OR strpos(after, sum) > h"),
    ("section_summary_provenance_missing", "true"),
    ("source_url_missing_from_reference", "true"),
])} AS page FROM x""")
def changed_pages(spark, d):
    """Pages with bullets, summaries and comments out of documents' sentences: what is wrong with each as it was rendered."""
    n = F.col("n_chars")
    s = n.cast("string")
    idea = lambda k: F.trim(F.regexp_replace(F.coalesce(F.get(F.split("t", r"\. "), F.lit(k - 1)), F.lit("")), "[^A-Za-z ]+", ""))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("t")).withColumns({"a": idea(1), "b": idea(2), "c": idea(3)})
    docs = docs.withColumns({"two": F.concat("b", F.lit(". "), "c"), "sum": F.concat(F.lit("Sum of "), "source"), "pa": editing.provenance(F.lit(""), F.col("lang"), F.col("a")), "pb": editing.provenance(F.lit("source_finding"), F.col("lang"), F.col("b"))})
    note = editing.finding_comment(F.lit("blocking"), F.lit("c1"), F.col("lang"))
    some = lambda test, *xs: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise("")
    c = F.col
    before = "---\ntitle: T\n---\n# T\n\n## Uses\n"
    after = F.concat(
        F.lit("---\ntitle: "), F.when(n % 13 == 0, "x").otherwise("T"), F.lit("\n---\n# T\n\n## Uses\n"), some(n % 5 == 0, "\n- ", c("a"), "[^1]\n"), some(n % 3 > 0, "\n", c("sum"), "[^1]\n"), F.lit("\n### Lipids\n\n- "), "a", F.lit("[^1]\n"), "pa", F.lit("\n- "), "two", F.when(n % 2 == 0, "[^1]").otherwise(""), F.lit("\n"), some(n % 7 < 4, c("pb"), "\n"), some((n % 3 == 0) & (n % 2 == 0), "\n", c("sum"), "[^1]\n"), some(n % 4 == 0, note, "\n"),
        some(n % 11 == 0, "See [it](#uses) and [that](#", c("source"), ").\n"), F.lit("\n[^1]: Source **DOI:** 10.5555/"), F.when(n % 17 == 0, "").otherwise(s), F.lit("\n"), some(n % 19 == 0, "[^2]: 10.5555/", s, " again\n"),
    )
    none = F.array().cast("array<string>")
    bullet = lambda t, p, animal, notes: F.struct(F.array(t).alias("texts"), p.alias("comment"), animal.alias("animal"), notes.alias("notes"))
    bullets = F.array(bullet(c("a"), c("pa"), c("lang") == "fr", F.array(note)), bullet(c("two"), c("pb"), F.lit(False), none))
    summary = F.struct(c("sum").alias("text"), editing.provenance(F.lit("section_summary"), c("lang"), c("sum")).alias("comment"))
    found = editing.page_issues(F.lit(before), c("after"), F.concat(F.lit("10.5555/"), s), F.lit("http://n.org/x"), bullets, F.lit("## Uses"), F.lit(True), summary)
    rows = docs.withColumn("after", after).select("doc_id", F.transform(found, lambda x: F.when(F.startswith(x, F.lit("dead_anchor_link_")), "dead_anchor_link").otherwise(x)).alias("x"))
    of_bullets = lambda x: F.startswith(x, F.lit("bullet_")) | F.startswith(x, F.lit("animal_"))
    return rows.select("doc_id", F.array_join(F.filter("x", of_bullets), ",").alias("bullets"), F.array_join(F.filter("x", lambda x: ~of_bullets(x)), ",").alias("page"))
