"""Expressions against small independent statements of their rules."""

import hashlib

from pyspark.sql import functions as F

from papertide.functions import classify, ids, text, udfs, values


def one(spark, *columns, **data):
    df = spark.createDataFrame([tuple(data.values())], list(data)) if data else spark.range(1)
    return tuple(df.select(*columns).first())


def test_normalizers(spark):
    got = one(spark, text.collapse("a"), text.key("b"), text.slug("b"), text.collapse_blocks("c"), text.is_truncated("d"), text.strip_citations("e"), udfs.folded_key("b"), udfs.unescape("f"), a=" x \t y\n", b="Crème  Brûlée-2!", c="a\r\n\n\n\nb\t c ", d="cut… ", e="One [1], two [2-4] .", f="a &amp; b&eacute;")
    assert got == ("x y", "cr me br l e 2", "cr-me-br-l-e-2", "a\n\nb c", True, "One, two.", "creme brulee 2", "a & bé")


def test_sentences_and_snippets(spark):
    s = "Doses of 5 mg were given to rats. Effects were seen by Smith et al. In the liver they lasted long (see below)."
    got = one(spark, text.bullet_sentences("s"), text.snippet(F.col("s"), ["effects"], 5, 10), text.truncate_at_word("s", 12), s=s)
    assert got[0] == ["Doses of 5 mg were given to rats.", "Effects were seen by Smith et al. In the liver they lasted long (see below)."]
    assert got[1].startswith("...") and "Effects" in got[1] and got[2] == "Doses of 5"


def test_phrases(spark):
    got = one(spark, text.phrase_count(F.col("t"), F.lit("green tea")), text.has_phrase(F.col("t"), F.lit("berry")), text.has_phrase(F.col("t"), F.lit("ea")), t="green tea green tea and berries")
    assert got == (1, True, False)


def test_overlap(spark):
    assert one(spark, text.overlap_ratio(F.lit("A b c"), F.lit("c, B a")), text.overlap_ratio(F.lit("a b c d"), F.lit("a b")), text.overlap_ratio(F.lit(""), F.lit("a"))) == (1.0, 0.5, 0.0)


def test_urls(spark):
    cases = {"HTTP://www.Example.org:80//a//b/?q=1#f": "https://example.org/a/b", "https://u:p@x.com": "https://x.com", " Not A Url ": "not a url", "": "", "ftp://h/p;v=1": "https://h/p"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "u string, want string")
    assert df.where(ids.canonical_url("u") != F.col("want")).collect() == []
    got = one(spark, ids.host_in("a"), ids.host_in("b"), ids.pmid("c"), ids.unwrap_redirect("d"), ids.host_matches(F.lit("x.y.org"), "*.y.org"), ids.host_matches(F.lit("y.org"), "*.y.org"), ids.safe_new_path(F.lit("D/a.md"), "D"), ids.safe_new_path(F.lit("D/../a.md"), "D"), a="https://www.mdpi.com/1", b="https://notmdpi.com", c="https://pubmed.ncbi.nlm.nih.gov/1234567/", d="https://scholar.google.com/scholar_url?url=https%3A%2F%2Fx.org%2Fa.pdf&hl=en")
    assert got == (True, False, "1234567", "https://x.org/a.pdf", True, True, True, False)


def test_identity(spark):
    got = one(spark, ids.identity_basis("t", "u"), ids.identity_basis("t", "v"), ids.identity_basis("t", F.lit(None).cast("string")), ids.paper_key("t", "v"), t="A Title!", u="https://doi.org/10.1000/ABC.1).", v="http://www.x.org/p/")
    assert got[:3] == ("doi:10.1000/abc.1", "url:https://x.org/p", "title:a title") and got[3] == hashlib.sha256(b"url:https://x.org/p").hexdigest()


def test_references(spark):
    page = "text [^2]\n\n[^2]: **Title:** [B](https://b)\n[^1]: [A]( https://a )\n"
    got = one(spark, ids.references("p"), ids.next_reference("p"), ids.next_reference(F.lit("")), p=page)
    assert [tuple(x) for x in got[0]] == [(1, "A", "https://a"), (2, "B", "https://b")] and got[1:] == (3, 1)


def test_values(spark):
    got = one(spark, values.partial_date(F.lit("2024/3/7")), values.partial_date(F.lit("2024-3")), values.partial_date(F.lit("soon")), values.count_authors(F.lit("A, B, …")), values.count_authors(F.lit("A and B")), values.count_authors(F.lit("A")), values.backoff_seconds(F.lit(1)), values.backoff_seconds(F.lit(9)), values.derived_state(F.lit("merged"), F.lit("p"), F.lit(""), F.lit("")), values.derived_state(F.lit(None).cast("string"), F.lit("p"), F.lit("c"), F.lit("")), values.json_object(F.lit('say ```json\n{"a": 1}\n``` ok')), values.choose_complete(F.array(F.lit("long but cut..."), F.lit("whole")), 100))
    assert got == ("2024-03-07", "2024-03", "soon", 2, 2, 1, 300, 21600, "merged", "committed", '{"a": 1}', "whole")


def test_classifiers(spark):
    kind = lambda t, p=(): classify.study_type(F.lit(t), F.lit(""), F.array(*map(F.lit, p)).cast("array<string>"), F.array().cast("array<string>"), F.lit(""))
    got = one(spark, kind("A meta-analysis after systematic review"), kind("Randomised controlled trial of x"), kind("x", ("Case Reports",)), kind("x"), classify.animal_model(F.lit("In fructose-fed rats and mice")), classify.with_scope(F.lit("Blood pressure fell."), F.lit("rats")), classify.with_scope(F.lit("Mice ate."), F.lit("rats")), classify.citation_markers(F.lit("a [1], b (Lee, 2020) [1]")), classify.marker_matches(F.lit("[2]"), F.lit("2. Lee")), classify.marker_matches(F.lit("(Lee, 2020)"), F.lit("Lee K. 2020. T.")))
    assert got == ("Systematic Review and Meta-Analysis", "Human Study: Randomized Controlled Trial", "Case Report", "Research Article", "fructose-fed rats", "In rats, blood pressure fell.", "Mice ate.", ["[1]", "(Lee, 2020)"], True, True)


def test_fatal_pages(spark):
    issues = classify.extraction_issues(F.col("t"), F.col("a"), F.col("b"))
    score = classify.extraction_score(F.col("t"), F.col("a"), F.col("b"), [])
    df = spark.createDataFrame([("Are you a robot?", "", "captcha challenge " * 400), ("Fine", "x" * 200, "y" * 900)], "t string, a string, b string")
    bad, good = df.select(issues.alias("i"), score.alias("s")).collect()
    assert bad.i == ["invalid_title", "captcha_page", "robot_page"] and bad.s < 0 and good.i == [] and good.s == 200 + 200 + 900


def test_similarity(spark):
    assert one(spark, udfs.token_similarity(F.lit("the cat sat"), F.lit("the cat sat")), udfs.token_similarity(F.lit("a b c d"), F.lit("a b x y")))[0:2] == (1.0, 0.5)
