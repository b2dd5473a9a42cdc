"""Footnotes of pages, checks of changed pages, survivorship over registries, numbering, tails of logs, lease timers."""

import pytest
from pyspark.sql import functions as F

from papertide.operators import intake, jobs, packets, papers, survivorship
from papertide.plans import editing
from papertide.streaming import leases

PAGE = "# A\n\n[^4]: **Title:** [T](http://t.org)<br>\n**DOI:** [10.5/X](https://doi.org/10.5/X)<br>\n**Source URL:** [u](http://U.org/p)\n[^9]: other http://u.org/p"


def test_shared_reference(spark):
    ask = [("10.5/x", ""), ("10.5/none", "http://u.org/p"), ("", "HTTP://u.org/p//"), (" ", " "), ("", "http://nowhere.org"), (None, None)]
    df = spark.createDataFrame(ask, "doi string, url string")
    got = [r[0] for r in df.select(editing.shared_reference(F.lit(PAGE), F.col("doi"), F.col("url"))).collect()]
    # a footnote runs to the next one; a DOI that isn't there isn't looked for by url; slashes at the end say nothing
    assert got == [4, 10, 4, 10, 10, 10]
    assert spark.range(1).select(editing.shared_reference(F.lit("# none"), F.lit("10.5/x"), F.lit(""))).first()[0] == 1


def issues(spark, after, summary=None, **more):
    note = editing.finding_comment(F.lit("review"), F.lit("c"), F.lit("why <b>"), F.lit(""))
    bullet = F.struct(F.array(F.lit("Tea lowered it")).alias("texts"), F.lit("  <!-- p -->").alias("comment"), F.lit(True).alias("animal"), F.array(note).alias("notes"))
    args = {"notes": F.array(F.lit("  <!-- all -->"))} | more
    found = editing.page_issues(F.lit("# T\n"), F.lit(after), F.lit("10.5/x"), F.lit("http://u.org"), F.array(bullet), F.lit("## Uses"), F.lit(True), summary, **args)
    return spark.range(1).select(found).first()[0]


def test_page_issues(spark):
    good = "# T\n\n## Uses\n\nIn short.[^1]\n<!-- s -->\n\n### Lipids\n\n- Tea lowered it[^1]\n  <!-- p -->\n  <!-- critic | severity: review | code: c | explanation: why &lt;b&gt; -->\n<!-- all -->\n\n## Next\n\n- not here\n\n[^1]: 10.5/x http://u.org\n"
    summary = F.struct(F.lit("In short.").alias("text"), F.lit("  <!-- s -->").alias("comment"))
    assert issues(spark, good, summary) == ["animal_bullet_missing_species_scope"]
    bad = "# T\n\n## Uses\n\n- Tea lowered it\n\n### Lipids\n\n- Pressure fell by a third. Sleep came back to them all.[^1]\n\nIn short. [x](#gone) <!-- [y](#gone-too) -->\n\n[^1]: 10.5/x\n[^2]: 10.5/X again\n"
    assert issues(spark, bad, summary) == sorted(["animal_bullet_missing_species_scope", "bullet_0_citation_missing", "bullet_0_provenance_missing", "bullet_0_critic_annotation_missing", "bullet_not_single_idea", "bullet_outside_property_subsection", "dead_anchor_link_gone", "duplicate_source_footnote", "section_summary_citation_missing", "section_summary_missing_or_misplaced", "section_summary_provenance_missing", "source_url_missing_from_reference", "target_critic_annotation_missing"])
    assert "reference_1_missing" in issues(spark, "# T\n", None)


def test_survivorship_over_registries(spark):
    columns = "packet_id long, title string, doi string, authors string, journal string, pub_date string, abstract string, url string, requested_url string, body_markdown string"
    rows = [(1, "Tea", "", "n/a", "Source", "", "", "https://pmc.ncbi.nlm.nih.gov/1", "see 10.5555/asked.", "10.5555/body"), (2, "", None, "Ñ", None, None, "x" * 130 + "…", "", "", "late " * 1000 + "10.5555/beyond"), (3, "Alone", "10.5555/own", "Lee", "J", "2020", "y" * 200, "u", "", "")]
    p = spark.createDataFrame(rows, columns)
    crossref = spark.createDataFrame([(1, "Tea", "Kim"), (1, "Tea", "Kim"), (2, "", "")], "packet_id long, title string, authors string")
    pubmed = spark.createDataFrame([(1, "J. of Tea", "77"), (2, "", "")], "packet_id long, journal string, pmid string")
    oa = spark.createDataFrame([(2, True, "http://oa")], "packet_id long, is_open_access boolean, best_open_access_url string")
    a, b, c = packets.survive(p, crossref, pubmed, oa).orderBy("packet_id").collect()
    assert (a.doi, a.authors, a.journal, a.pmid, a.is_open_access, a.doi_title_score, a.enrichment_sources) == ("10.5555/asked", "Kim", "J. of Tea", "77", True, 1.0, ["crossref", "pubmed"])
    assert a.repairs == ["doi:discarded_placeholder_or_normalized", "authors:discarded_placeholder", "journal:discarded_placeholder", "authors:recovered_from_crossref", "journal:recovered_from_pubmed"]
    assert (b.doi, b.authors, b.abstract, b.is_open_access, b.best_open_access_url, b.repairs) == ("", "", "x" * 130 + "…", True, "http://oa", ["authors:discarded_placeholder"])
    assert (c.doi, c.authors, c.enrichment_sources, c.repairs, c.is_open_access) == ("10.5555/own", "Lee", [], [], False)
    # another registry is another line of the table
    more = (*survivorship.LATTICE, survivorship.Repair("title", ("local",), survivorship.missing, "title:recovered_from_local"))
    found = survivorship.survive(p, {"local": spark.createDataFrame([(2, "Ours")], "packet_id long, title string")}, more)
    assert [(r.title, r.repairs[-1:]) for r in found.where("packet_id = 2").collect()] == [("Ours", ["title:recovered_from_local"])]


def test_numbered(spark):
    keys = [f"{i * 7919 % 5000:04x}" for i in range(300)] + ["a", "", "zz"]
    got = {r.k: r.n for r in jobs.numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(5), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys), 1)}


@pytest.mark.parametrize("offset", [-3, 0, 1, 4, 5, 6, 9, 10, 11, 40])
def test_turns_tail(spark, offset):
    log = "ab1é\nxyz\n\nq"  # turns of 4, 3, 0 and 1 characters
    turns = spark.createDataFrame([(1, i, t) for i, t in enumerate(log.split("\n"))] + [(1, 9, None), (2, 0, "")], "id long, turn long, text string").repartition(3)
    got = {r.id: (r.chunk, r.next_offset, r.reset) for r in papers.turns_tail(turns, "id", "turn", "text", F.lit(offset).cast("long")).collect()}
    reset = offset > len(log)
    assert got[1] == (log if reset or offset < 0 else log[offset:], len(log), reset)
    assert got[2] == ("", 0, offset > 0)


def test_mail_queries(spark):
    rows = [("base ", None, None, None), ("b", " ", "2024-01-02", ""), (" b", " from:x ", "2024-01-02", "2024-02-03"), ("b", "", None, "2024-02-03")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, e string, x string, y string").select(intake.mail_queries(*map(F.col, "bexy"))).collect()]
    assert got == [intake.mail_query(b, e or "", x, y) for b, e, x, y in rows]


def test_lease_timers(spark, tmp_path):
    schema = "job_id long, event_id long, to_state string, created_at timestamp"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"

    def run(k, rows, known=None):
        df = spark.createDataFrame([(j, e, s, at(m)) for j, e, s, m in rows], "job_id long, event_id long, to_state string, created_at string")
        df.select("job_id", "event_id", "to_state", F.col("created_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        leases.run_once(leases.watched(stream, 3600, "10 minutes", known=known), f"{tmp_path}/run")
        return sorted((r.job_id, r.what, r.state, r.n_events) for r in spark.read.parquet(f"{tmp_path}/run/out").collect())[:]

    old = spark.createDataFrame([(5, 1, "leased", "2024-01-01 00:00:00")], "job_id long, event_id long, to_state string, created_at string")
    first = run(0, [(1, 10, "leased", 60), (2, 11, "leased", 60), (3, 12, "leased", 60), (3, 13, "scraping", 150), (4, 14, "queued", 61)], leases.known_jobs(old))
    # job 3 was silent for more than an hour between two events; jobs 1, 2 and 5 until the watermark had passed
    assert [x for x in first if x[1] == "expired"] == [(1, "expired", "leased", 1), (2, "expired", "leased", 1), (3, "expired", "leased", 1), (5, "expired", "leased", 1)]
    second = run(1, [(2, 20, "leased", 160), (2, 20, "leased", 160), (3, 21, "pr_open", 170), (1, 9, "failed", 30), (4, 22, "leased", 200)], leases.known_jobs(old))
    new = [x for x in second if x not in first or second.count(x) > first.count(x)]
    # an event that comes again counts once; one that is too late isn't taken; job 3 stopped in time
    assert (2, "state", "leased", 2) in new and (3, "state", "pr_open", 3) in new and not [x for x in new if x[0] in (1, 3) and x[1] == "expired"]
    assert (1, "state", "failed", 2) not in new
