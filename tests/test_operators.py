"""Operators over small tables shaped like the domain's."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papertide.functions import udfs
from papertide.operators import catalog, intake, jobs, packets, papers
from papertide.plans import editing, validate
from papertide.sources import readers, writers

NOW = dt.datetime(2024, 5, 1)


def test_triage(spark):
    df = spark.createDataFrame([("A systematic review of patients", 4), ("Dog food for dogs", 1), ("Plain", None)], "t string, n int")
    got = [tuple(r.x) for r in df.select(intake.triage(F.col("t"), F.col("n")).alias("x")).collect()]
    assert got == [(3 + 4 + 2 + 2, "selected", ["+3:review", "+4:systematic review", "+2:patients", "+2:multi-author"]), (-7, "rejected", ["-5:dog food", "-2:single-author"]), (0, "review", [])]


def test_alert_mail(spark):
    html = """<html><title>t</title><h3><span>[PDF]</span><a class="gse_alrt_title" href="https://scholar.google.com/scholar_url?url=https%3A%2F%2Fx.org%2Fa.pdf">A  clinical review</a></h3><div>A Lee, B Kim - Journal, 2024</div><div>of human disease</div>
    <h3><a class="gse_alrt_title" href="https://scholar.google.com/scholar_alerts?view_op=list">settings</a></h3><h3><a class="gse_alrt_title" href="https://y.org/b">Soil and fish</a></h3><div>C Doe</div><div>feed</div><a href="/scholar?q=tea">[ green tea ]</a></html>"""
    rows = intake.parse_candidates(spark.createDataFrame([("m", html, "s")], "message_id string, html string, subject string"), udfs.alert_candidates).collect()
    assert [(r.rank_in_email, r.title, r.article_url, r.author_count, r.status, r.format_label) for r in rows] == [(1, "A clinical review", "https://x.org/a.pdf", 2, "selected", "PDF"), (2, "Soil and fish", "https://y.org/b", 1, "rejected", None)]
    assert rows[0].alert_name == " green tea " or rows[0].alert_name.strip() == "green tea"


def test_mail_parts(spark):
    import base64
    import json

    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    plain, page = {"mimeType": "text/plain", "body": {"data": enc("plain")}}, {"mimeType": "text/html", "body": {"data": enc("<p>ü</p>")}}
    rows = [json.dumps({"payload": {"headers": [{"name": "Subject", "value": "a"}, {"name": "SUBJECT", "value": "b"}], "parts": parts}}) for parts in ([page, plain], [plain, page], [])]
    df = spark.createDataFrame([(r,) for r in [*rows, "{}", "no json"]], "raw string")
    assert [r[0] for r in df.select(udfs.message_html("raw")).collect()] == ["<p>ü</p>", "plain", "", "", ""]
    assert df.select(udfs.message_headers("raw")["subject"]).first()[0] == "b"


def test_backlog_filters_before_it_limits(spark):
    articles = spark.createDataFrame([(str(i), f"p{i}", "a", f"https://{'x' if i % 2 else 'y'}.org/{i}", 10 + i, "selected", True, None if i != 5 else NOW, NOW) for i in range(8)], "article_key string, paper_key string, alert_name string, article_url string, score int, status string, is_open_access boolean, processed_at timestamp, created_at timestamp")
    ps = spark.createDataFrame([("p7", "", "", "", "merged"), ("p3", "", "", "", "scraped")], "paper_key string, canonical_url string, doi string, pmid string, workflow_state string")
    assert [r.article_key for r in intake.backlog(articles, ps, source="x.org", limit=2).collect()] == ["3", "1"]
    assert [r.article_key for r in intake.backlog(articles, ps, min_score=16, include_processed=True).collect()] == ["7", "6"]


def test_blank_ids_match_nothing(spark):
    ps = spark.createDataFrame([("k1", "", "", ""), ("k2", "https://x.org/a", "10.1000/abc", "777777")], "paper_key string, canonical_url string, doi string, pmid string")
    probes = spark.createDataFrame([("",), ("10.9999/none",), ("777777",), ("http://www.x.org/a/",), ("doi 10.1000/ABC",), ("k1",)], "identifier string")
    assert {r.identifier: r.paper_key for r in intake.resolve_papers(ps, probes).collect()} == {"777777": "k2", "http://www.x.org/a/": "k2", "doi 10.1000/ABC": "k2", "k1": "k1"}


def test_no_nested_loop_in_the_anti_join(spark):
    a = spark.createDataFrame([("1", "u", "s"), ("2", None, "t"), ("3", "v", None)], "article_key string, article_url string, scholar_url string")
    j = spark.createDataFrame([("9", "t"), ("3", None)], "article_key string, source_url string")
    out = intake.without_jobs(a, j)
    assert [r.article_key for r in out.collect()] == ["1"]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_states_only_rise(spark):
    ps = spark.createDataFrame([("a", "scraped", None, None, None), ("b", "merged", None, None, None)], "paper_key string, workflow_state string, published_pr string, pr_opened_at timestamp, updated_at timestamp")
    changes = spark.createDataFrame([("a", "scraped", "", "", "pr1", ""), ("b", "matched", "x.md", "", "", "")], "paper_key string, state string, matched_content_path string, commit string, pr string, archive_path string")
    got = {r.paper_key: r for r in papers.advance(ps, changes, F.lit(NOW)).collect()}
    assert (got["a"].workflow_state, got["a"].published_pr, got["a"].pr_opened_at) == ("pr_open", "pr1", NOW) and got["b"].workflow_state == "merged"


def test_merges(spark):
    cur = spark.createDataFrame([("a", "T", "d", 1), ("b", "U", "e", 1)], "paper_key string, title string, doi string, updated_at int")
    new = spark.createDataFrame([("a", "", "f", 2), ("c", "V", "", 2)], "paper_key string, title string, doi string, updated_at int")
    assert sorted(map(tuple, papers.upsert_papers(cur, new).collect())) == [("a", "T", "f", 2), ("b", "U", "e", 1), ("c", "V", "", 2)]


def make_jobs(spark):
    h = lambda n: NOW + dt.timedelta(hours=n)
    return spark.createDataFrame([(1, "queued", 0, 3, h(-9), None, None, None, None, NOW), (2, "retry", 1, 3, h(-8), h(1), None, None, None, NOW), (3, "leased", 1, 3, h(-7), None, h(-1), "w", None, NOW), (4, "leased", 1, 3, h(-6), None, h(2), "w", None, NOW), (5, "queued", 3, 3, h(-5), None, None, None, None, NOW), (6, "validated", 1, 3, h(-4), None, h(-1), None, NOW, NOW)], "job_id long, state string, attempt_count int, max_attempts int, created_at timestamp, next_run_at timestamp, lease_expires_at timestamp, lease_owner string, finished_at timestamp, updated_at timestamp")


def test_queue(spark):
    js, now = make_jobs(spark), F.lit(NOW)
    assert sorted(r.job_id for r in jobs.claimable(js, now).collect()) == [1, 3]
    first = jobs.claim(js, "me", 60, now).first()
    assert (first.job_id, first.state, first.attempt_count, first.lease_expires_at) == (1, "leased", 1, NOW + dt.timedelta(seconds=60))
    with pytest.raises(ValueError):
        jobs.claim(js, " ", 60, now)
    changes = spark.createDataFrame([(3, "retry", "w"), (4, "failed", "other"), (1, "nonsense", "")], "job_id long, state string, worker string")
    got = {r.job_id: r for r in jobs.set_state(js, changes, now).collect()}
    assert (got[3].state, got[3].next_run_at, got[3].lease_owner) == ("retry", NOW + dt.timedelta(seconds=300), None)
    assert got[4].state == "leased" and got[1].state == "queued"
    back = {r.job_id: (r.state, r.attempt_count) for r in jobs.requeue(js, js.select("job_id"), now).collect()}
    assert back[6] == ("queued", 0) and back[3] == ("leased", 1)


def test_enqueue_one_for_each_source(spark):
    a = spark.createDataFrame([("a", "p", "https://x.org/1", None, "selected", "D", 9, None, NOW), ("b", "p", "http://www.x.org/1/?q", None, "selected", "D", 8, None, NOW), ("c", "q", None, "https://y.org", "selected", "D", 7, None, NOW), ("d", "q", "https://z.org", None, "selected", "D", 6, None, NOW)], "article_key string, paper_key string, article_url string, scholar_url string, status string, domain string, score int, processed_at timestamp, created_at timestamp")
    ps = spark.createDataFrame([("p", "discovered")], "paper_key string, workflow_state string")
    js = spark.createDataFrame([(41, "zz", "http://z.org/", None, "scraping")], "job_id long, article_key string, source_url string, canonical_source_url string, state string")
    assert [(r.job_id, r.article_key) for r in jobs.enqueue_backlog(a, ps, js, "selected", "D", 0, 5).orderBy("job_id").collect()] == [(42, "a"), (43, "c")]


def test_log_tail(spark):
    got = spark.createDataFrame([("hello", 2), ("hi", 9)], "l string, o int").select(papers.log_tail(F.col("l"), F.col("o")).alias("t")).collect()
    assert [tuple(r.t) for r in got] == [("llo", 5, False), ("hi", 2, True)]


PAGES = [("D/Teas/green-tea.md", "Green Tea", "green-tea", ["tea", "Drinks"], "/green", "Green tea holds catechins and more."), ("D/Health/sleep.md", "Sleep", "sleep", ["rest"], None, "A green field. [^1]: [Tea study](https://doi.org/10.1000/x)"), ("E/green-tea.md", "Green Tea", "green-tea", [], None, "")]
PAGE_COLUMNS = "path string, title string, stem string, tags array<string>, permalink string, body string"


def test_search(spark):
    pages = spark.createDataFrame(PAGES, PAGE_COLUMNS)
    got = [(r.path, r.score) for r in catalog.search(pages, "Green tea", "phrase").collect()]
    assert got[0] == ("D/Teas/green-tea.md", 30 + 15 + 15 + 30) and len(got) == 2
    assert [r.path for r in catalog.search(pages, "green catechins", "all").collect()] == ["D/Teas/green-tea.md"]
    assert len(catalog.search(pages, "green rest", "any").collect()) == 3
    with pytest.raises(ValueError):
        catalog.search(pages, "!!")


def test_retrieval(spark):
    pages = spark.createDataFrame(PAGES, PAGE_COLUMNS)
    p = spark.createDataFrame([(1, "Effects of green tea", "tea", "Green tea catechins helped.", "## Intro\ngreen tea\n## References\ngreen tea green tea", ""), (2, "Black coffee", "", "", "", "")], "packet_id int, title string, keywords string, abstract string, full_text string, alert string")
    got = catalog.retrieve(pages, p, "D").collect()
    assert [(r.packet_id, r.path) for r in got] == [(1, "D/Teas/green-tea.md")]
    assert got[0].entity_matches == ["green tea"] and got[0].score_components["title"] == 240 and got[0].score_components["full_text"] == 25 and got[0].score_components["tags"] == 18


def test_tags_lint_references(spark):
    pages = spark.createDataFrame([("a", ["Tea", "tea", "Food"]), ("b", ["Tea"]), ("c", ["food!"])], "path string, tags array<string>")
    got = {r.normalized: (r.total, r.suggested_canonical, r.example_paths) for r in catalog.audit_tags(pages).collect()}
    assert got == {"tea": (3, "Tea", ["a", "b"]), "food": (2, "Food", ["a", "c"])}
    assert [r.tag for r in catalog.suggest_tags(catalog.tag_counts(pages), "tea").collect()] == ["Tea", "tea"]
    content = spark.createDataFrame([(1, "Some TEA here", ["Food"])], "id int, text string, tags array<string>")
    assert [r.tag for r in catalog.tags_in(content, catalog.tag_counts(pages)).collect()] == ["Tea", "tea"]
    rows = [("x", "T", ["a", "A"], True, "b", None), ("y", None, None, None, " ", None), ("z", None, None, None, "b", "bad"), ("w", "T", ["a"], True, "b", None)]
    lint = {r.path: r.issues for r in catalog.lint(spark.createDataFrame(rows, "path string, title string, tags array<string>, tags_is_list boolean, body string, error string")).collect()}
    assert lint == {"x": ["duplicate_tags"], "y": ["missing_title", "missing_tags", "empty_body"], "z": ["invalid_frontmatter"]}
    cited = catalog.cited_in(spark.createDataFrame(PAGES, PAGE_COLUMNS), spark.createDataFrame([("http://doi.org/10.1000/X/",), ("https://none",)], "url string")).collect()
    assert [(r.path, r.ref_num) for r in cited] == [("D/Health/sleep.md", 1)]
    dup = catalog.duplicate_papers(spark.createDataFrame(PAGES, PAGE_COLUMNS), spark.createDataFrame([("10.1000/x",), ("tea study",)], "identifier string")).collect()
    assert sorted(r.identifier for r in dup) == ["10.1000/x", "tea study"]
    anchors = catalog.dead_anchors(spark.createDataFrame([("p", "## My Part\n[a](#my-part) [b](#gone) <a id='x'></a> [c](#x)")], "path string, body string")).collect()
    assert [r.anchor for r in anchors] == ["gone"]


def test_containment(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "one two three four five six\nseven"), (3, "tiny bit"), (4, None)], "id int, text string")
    items = spark.createDataFrame([(10, "one two three four five six seven"), (11, "tiny"), (12, "")], "item_id int, passage string")
    assert sorted(map(tuple, catalog.containing(docs, items).collect())) == [(1, 10), (3, 11)]


def test_sections_and_packing(spark):
    body = "lead\n# Paper\n## Abstract\n" + "a" * 50 + "\n## Results\nr\n### Detail\n" + "d" * 40 + "\n## Other\nskip\n## Introduction\ni\n## References\n[1] x"
    s = packets.grouped_sections(packets.headed_sections(spark.createDataFrame([(1, body)], "id int, body string"), "id", F.col("body")), "id")
    assert [(r.heading, r.group) for r in s.orderBy("pos").collect()] == [("Document metadata", None), ("Paper", None), ("Abstract", "abstract"), ("Results", "results"), ("Detail", "results"), ("Other", None), ("Introduction", "introduction")]
    got = packets.pack(s, "id", {"abstract": 20, "results": 30, "introduction": 50}, 60).orderBy("pos").collect()
    assert [(r.heading, r.kept_chars) for r in got] == [("Abstract", 20), ("Results", 12), ("Detail", 18), ("Introduction", 10)]
    kept = spark.range(1).select(packets.pack_skipping(F.array(F.lit("aaaa"), F.lit("bbbbbb"), F.lit("cc")), 7)).first()[0]
    assert kept == ["aaaa", "cc"]


def test_windows_around_hits(spark):
    df = spark.createDataFrame([(1, "x tea y tea z" + " " * 30 + "Tea")], "id int, t string")
    hits = packets.hit_windows(df, "id", F.col("t"), "tea", 2, 6)
    assert sorted((r.start, r.end) for r in hits.collect()) == [(0, 8), (6, 14), (41, 46)]
    assert sorted((r.start, r.end) for r in packets.merge_windows(hits, "id").collect()) == [(0, 14), (41, 46)]


def test_survivorship_and_gate(spark):
    p = spark.createDataFrame([(1, "Tea and sleep", "doi: 10.1000/x.", "Authors", "", None, "cut off...", "https://a.org"), (2, "Other title", "10.1000/y", "A" * 1300, "J", "2020", "b" * 200, "")], "packet_id int, title string, doi string, authors string, journal string, pub_date string, abstract string, url string")
    c = spark.createDataFrame([(1, "Tea and sleep", "10.1000/x", "Lee K", "Sleep", "2021-02", "c" * 150), (2, "Nothing alike here", "", "Kim", "", "", "")], "packet_id int, title string, doi string, authors string, journal string, pub_date string, abstract string")
    m = spark.createDataFrame([(1, "", "", "", "Pub", "", "")], "packet_id int, title string, doi string, authors string, journal string, pub_date string, abstract string")
    a, b = packets.survive(p, c, m).orderBy("packet_id").collect()
    assert (a.doi, a.authors, a.journal, a.pub_date, a.abstract, a.consistency) == ("10.1000/x", "Lee K", "Sleep", "2021-02", "c" * 150, [])
    assert "authors:discarded_placeholder" in a.repairs and "abstract:recovered_from_crossref" in a.repairs
    assert b.authors == "Kim" and b.consistency == ["doi_title_mismatch"]
    rows = [("T", "x" * 130, "", "10.1000/a", "Lee", "J", "2020", "https://doi.org/10.1000/A", []), ("Access denied", "short…", "", "bad", "unknown", "", "", "nope", ["captcha_page"])]
    good, bad = packets.gate(spark.createDataFrame(rows, "title string, abstract string, body_markdown string, doi string, authors string, journal string, pub_date string, reference_url string, retrieval_issues array<string>").withColumn("consistency", F.array().cast("array<string>"))).collect()
    assert good.ok and bad.issues == sorted(["captcha_page", "insufficient_source_evidence", "invalid_doi", "invalid_reference_url", "invalid_title", "missing_or_placeholder_authors", "missing_or_placeholder_journal", "missing_or_placeholder_pub_date", "truncated_abstract"])


def test_small_rules(spark):
    got = spark.range(1).select(packets.choose_abstract([F.array(F.lit("cut...")), F.array(F.lit("y" * 130), F.lit("z" * 125))]), packets.identifiers(F.lit("10.1/x"), F.lit("https://A.org/"), F.lit("https://a.org")), packets.key_findings(F.lit("The start of it all is here now. Pressure fell by a third in all groups. Short.")), jobs.outcome(F.lit("see https://github.com/a/b/pull/7"), F.lit(0))).first()
    assert got[0] == "y" * 130 and got[1] == ["https://A.org/"] and got[2] == ["Pressure fell by a third in all groups."] and tuple(got[3]) == ("completed", "https://github.com/a/b/pull/7")


QUOTE = "Green tea lowered blood pressure in hypertensive rats over eight weeks."


def test_plans(spark):
    packet = spark.createDataFrame([(1, "Green tea in rats", "", f"## Results\n{QUOTE}\n## Introduction\nold", "Animal Study", "")], "packet_id int, title string, abstract string, body_markdown string, study_type string, keywords string")
    pages = spark.createDataFrame([("D/green-tea.md", "Green Tea")], "path string, title string")
    good = (QUOTE, QUOTE, "Results", "source_finding", "animal", "Blood Pressure", 0)
    bad = ("- Coffee cures", "not there", "Nowhere", "guess", "all", "", 1)
    target = lambda bullets, path="D/green-tea.md", op="append_existing": (op, path, "green tea", "## Healing Properties", "", "why", None, bullets)
    rows = [("ok", 1, "publish_changes", "animal study", [target([good])]), ("bad", 1, "publish_changes", "human study", [target([bad]), target([good], "D/x.md"), target([good], "../y.md", "create_new")]), ("none", 1, "maybe", "", [])]
    got = {r.plan_id: r for r in validate.validate(spark.createDataFrame(rows, f"plan_id string, packet_id int, decision string, study_type string, targets array<{validate.TARGET}>"), packet, pages, "D").collect()}
    assert got["ok"].ok and got["ok"].issues == []
    assert {"study_type_mismatch", "target_0_bullet_0_invalid_text", "target_0_bullet_0_quote_not_in_source", "target_0_bullet_0_invalid_claim_kind", "target_0_bullet_0_external_reference_not_allowed", "target_1_not_in_candidates", "target_1_entity_mismatch", "target_2_invalid_new_article_path", "target_2_missing_new_article_title", "target_2_bullet_0_claim_assigned_to_multiple_targets"} <= set(got["bad"].issues)
    assert got["none"].issues == ["invalid_decision"]


def test_critics(spark):
    rows = [("r", "unsupported_claim", "warning", 0, "Not in the text", "source words", "", "the source words here", "", 1, ""), ("r", "unsupported_claim", "review", 3, "The claim is supported", "invented", "", "the source words here", "", 1, ""), ("s", "merged_ideas", "warning", None, "two ideas", "words", "", "the source words here", "", 1, "")]
    df = spark.createDataFrame(rows, "review_id string, code string, severity string, bullet_index int, explanation string, source_quote string, target_quote string, evidence string, target string, n_bullets int, operation string")
    a, b, c = validate.critic_issues(df, "evidence").collect()
    assert a.accepted and a.severity == "review" and b.errors == ["invalid_bullet_index", "self_contradictory_issue", "source_quote_not_exact"] and c.severity == "warning"
    assert {r.review_id: r.recommendation for r in validate.combine_reviews(validate.critic_issues(df, "evidence")).collect()} == {"r": "revise", "s": "approve"}


def test_editing(spark):
    page = "# P\n\n## A\ntext\n### B\nb\n## C\nc\n\n[^1]: [x](u)\n"
    assert editing.insert_block(page, "## A", "", "- new") == "# P\n\n## A\ntext\n### B\nb\n\n- new\n\n## C\nc\n\n[^1]: [x](u)\n"
    assert "c\n\n## D\n\n- new\n\n[^1]:" in editing.insert_block(page, "## D", "", "- new")
    with pytest.raises(ValueError):
        editing.insert_block(page, "#### D", "## A", "- new")
    got = spark.createDataFrame([(page, "### E", "## A", "- n"), (page, "### E", "## Z", "- n")], "p string, h string, q string, b string").select(editing.inserted("p", "h", "q", "b").alias("x")).collect()
    assert "### E\n\n- n" in got[0].x.page and got[1].x.error
    body = "[^3]: [t](https://doi.org/10.1000/x)\n[^4]: [u](https://y)"
    r = spark.range(1).select(editing.shared_reference(F.lit(body), F.lit("10.1000/X"), F.lit("")), editing.shared_reference(F.lit(body), F.lit(""), F.lit("https://z")), editing.rendered_issues(F.lit("a"), F.lit("a\n- b[^1]\n[^1]: 10.1 u [l](#no)"), F.lit(1), F.lit("10.1"), F.lit("u"), F.array(F.lit("b"), F.lit("c")))).first()
    assert tuple(r) == (3, 5, ["bullet_citation_missing", "dead_anchor_link"])


def test_markdown_and_html(spark, tmp_path):
    (tmp_path / "D").mkdir()
    (tmp_path / "D" / "a.md").write_text("---\ntitle: A\ntags: [x, y]\n---\nbody\n")
    (tmp_path / "D" / "b.md").write_text("no front matter")
    (tmp_path / "D" / "c.md").write_text("---\ntags: [x\n---\nbad\n")
    got = {r.path: r for r in readers.markdown_pages(spark, str(tmp_path)).collect()}
    assert (got["D/a.md"].title, got["D/a.md"].tags, got["D/a.md"].body.strip()) == ("A", ["x", "y"], "body")
    assert got["D/b.md"].title == "b" and got["D/c.md"].error
    html = '<html><head><title>T | P</title><meta name="citation_title" content="A longer title of it"><meta name="citation_author" content="Lee"><meta content="10.1000/q" name="citation_doi"></head><body><h1>T</h1><p>in vitro text</p></body></html>'
    r = readers.html_packets(spark.createDataFrame([("https://x.org", html)], "url string, html string")).first()
    assert (r.title, r.authors, r.doi, r.study_type, r.reference_url) == ("A longer title of it", "Lee", "10.1000/q", "Cell Study: In Vitro", "https://doi.org/10.1000/q")
    p = readers.pdf_text(spark.createDataFrame([("Title\nAbstract: Tea is good. Keywords: tea; sleep. Introduction more",)], "text string")).first()
    assert (p.abstract, p.keywords) == ("Tea is good.", "tea; sleep")


def test_rendering(spark):
    df = spark.createDataFrame([("T", "Lee", "", "2020", "10.1/x", "https://u", "Abs", "Body")], "title string, authors string, journal string, pub_date string, doi string, url string, abstract string, body_markdown string")
    r = df.select(writers.footnote(F.lit(2), F.col("title"), writers.citation_url(F.col("doi"), F.col("url")), F.col("authors"), F.col("journal"), F.col("pub_date"), F.col("doi")), writers.packet_markdown(df), writers.envelope(F.col("title"))).first()
    assert r[0] == "[^2]: **Title:** [T](https://doi.org/10.1/x)  \n    **Authors:** Lee  \n    **Date:** 2020  \n    **DOI:** 10.1/x" and r[1].startswith("# T\n\n- Authors: Lee") and r[2] == '{"ok":true,"result":"T"}'
