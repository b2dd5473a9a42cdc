from pyspark.sql import functions as F

from papertide.functions.publishers import article_page
from papertide.plans import normalize

CASES = {
    "https://journals.sagepub.com/doi/pdf/10.1177/096?x=1": "https://journals.sagepub.com/doi/full/10.1177/096",
    "https://acsess.onlinelibrary.wiley.com/doi/pdfdirect/10.1002/agg": "https://acsess.onlinelibrary.wiley.com/doi/abs/10.1002/agg",
    "https://academic.oup.com/p/advance-article-pdf/doi/10.1093/p/g8/623/g8.pdf": "https://doi.org/10.1093/p/g8",
    "https://link.springer.com/content/pdf/10.1007/s1-3.pdf": "https://link.springer.com/article/10.1007/s1-3",
    "https://www.mdpi.com/22/13/3/767/pdf": "https://www.mdpi.com/22/13/3/767",
    "https://www.tandfonline.com/doi/pdf/10.1080/1": "https://www.tandfonline.com/doi/full/10.1080/1",
    "https://www.frontiersin.org/articles/10.3389/x/pdf": "https://www.frontiersin.org/articles/10.3389/x/full",
    "https://www.cell.com/heliyon/pdf/S2405-8440(24)1.pdf": "https://www.cell.com/heliyon/fulltext/S2405-8440(24)1.pdf",
    "https://www.sciencedirect.com/science/article/pii/S1/pdfft?md5=1": "https://www.sciencedirect.com/science/article/pii/S1",
    "https://other.org/doi/pdfdirect/10.1/x": "https://other.org/doi/abs/10.1/x",
    "/tmp/paper.pdf": "/tmp/paper.pdf",
    "https://www.nature.com/articles/s4": "https://www.nature.com/articles/s4",
}


def test_publisher_links(spark):
    df = spark.createDataFrame(list(CASES.items()), "u string, want string").withColumn("p", article_page("u"))
    assert {r.u: r.p.url for r in df.collect()} == CASES
    assert df.where((F.col("u") != F.col("want")) & F.col("p.note").isNull()).count() == 0


Q = "Green tea lowered blood pressure in hypertensive rats over eight weeks [3]."


def test_bullets_are_cleaned_with_a_log(spark):
    text = f"Intro. {Q.replace(' ', chr(160))} End."
    rows = [("## Healing Properties", "Green tea lowered blood pressure in hypertensive rats over eight weeks [3].", Q, "", "source_finding", 1, text), ("## X", "Coffee is best", Q, "S", "source_finding", 0, text), ("## X", "t", "never said anywhere in the source at all, not once", "S", "x", 0, text)]
    got = normalize.bullets(spark.createDataFrame(rows, "heading string, text string, source_quote string, subsection string, claim_kind string, n_references int, evidence string")).collect()
    assert [r.kept for r in got] == [True, True, False]
    assert got[0].actions == ["restored_source_whitespace", "removed_external_reference_fields", "added_property_subsection", "removed_publisher_markers"] and got[0].subsection == "Blood Pressure"
    assert got[0].source_quote == Q.replace(" ", chr(160)) and got[1].text.startswith("Green tea lowered") and "replaced_text_with_source_quote" in got[1].actions


def test_compounds(spark):
    s = spark.createDataFrame([("p", "The compound Lycopene (LYC) was found."), ("p", "A compound, Glioma (GBM) cells.")], "plan_id string, sentence string")
    b = spark.createDataFrame([("p", 0, "Lycopene fell"), ("p", 1, "LYC rose"), ("p", 2, "GBM"), ("p", 3, "Glioma")], "plan_id string, bullet int, text string")
    page = lambda t: spark.createDataFrame([("p", t)], "plan_id string, markdown string")
    assert [(r.name, r.n, r.bullet_index) for r in normalize.compounds(s, b, page("# Tomato")).collect()] == [("Lycopene", 2, 0)]
    assert normalize.compounds(s, b, page("# Lycopene")).count() == 0


def test_seeds(spark):
    p = spark.createDataFrame([(1, "Berries and sleep", "", "", "tart cherry"), (2, "Nothing", "", "", "")], "packet_id int, title string, abstract string, keywords string, alert string")
    c = spark.createDataFrame([("D/Foods/berry",), ("D/Foods/tart-cherry",), ("D/chemicals",)], "category string")
    none = spark.createDataFrame([], "path string")
    assert [(r.packet_id, r.path, r.score) for r in normalize.page_seeds(p, c, none, "D").collect()] == [(1, "D/Foods/tart-cherry/tart-cherry.md", 300)]
