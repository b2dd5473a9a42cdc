"""Plans that hold at size, and operators that SQL can't express against plain recomputations."""

import datetime as dt
import random
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from papertide.functions import markdown, udfs
from papertide.operators import catalog, intake, packets
from papertide.streaming import events


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_taken_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id", F.lit("x").alias("body"))
    for found in (intake.keep_first(df, F.col("k"), [F.desc("id")]), packets.best_attempt(df, "k", F.col("id"), "id")):
        assert plan_of(found).count("WindowGroupLimit") == 2
        assert {r.k: r.id for r in found.collect()} == {k: max(i for i in range(1000) if i % 7 == k) for k in range(7)}


def test_a_page_gathers_no_rows(spark):
    page = intake.page_of(spark.range(1000), [F.desc("id")], 20, 30)
    assert "Window" not in plan_of(page) and "TakeOrderedAndProject" in plan_of(page)
    got = page.collect()
    assert [r.id for r in got] == list(range(979, 949, -1)) and {r.total for r in got} == {1000}


def test_example_paths_are_bounded(spark):
    pages = spark.range(500).select(F.format_string("p%03d", 499 - F.col("id")).alias("path"), F.array(F.when(F.col("id") % 2 == 0, "Tag").otherwise("tag")).alias("tags"))
    found = catalog.audit_tags(pages)
    assert "WindowGroupLimit" in plan_of(found)
    assert found.first().example_paths == [f"p{i:03d}" for i in range(5)]


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["the", "of", "a", "rare", "words", "stand", "in", "texts", "be", "low"]
    texts = [(i, rng.choice(["", " "]) + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) + rng.choice(["", "!", "\n"])) for i in range(80)] + [(99, None)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))) for i in range(40)] + [(50, ""), (51, "x"), (52, "ow"), (53, "he of a"), (54, None), (55, "a rare words"), (56, "never said at all here")]
    docs, items = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(passages, "item_id long, passage string")
    want = sorted((i, k) for i, t in texts if t is not None for k, p in passages if p and p in t)
    assert sorted(map(tuple, catalog.containing(docs, items).collect())) == want
    monkeypatch.setattr(catalog, "FEW", 3)  # short passages by their runs of characters
    assert sorted(map(tuple, catalog.containing(docs, items).collect())) == want


def test_duplicates_inside_urls(spark):
    urls = ["http://a.org/x/abc123?y=1", "https://b.org/ABC12", "http://c.org/q"]
    body = "\n".join(f"[^{i}]: [T{i}]({u})" for i, u in enumerate(urls))
    pages = spark.createDataFrame([("p.md", body)], "path string, body string")
    probes = ["bc123?y", "abc12", "org", "q", "zzz", "HTTP://A.ORG/X", "t2"]
    got = sorted((r.identifier, r.ref_num) for r in catalog.duplicate_papers(pages, spark.createDataFrame([(x,) for x in probes], "identifier string")).collect())
    assert got == sorted({(p, i) for p in probes for i, u in enumerate(urls) if p.lower() in u.lower()} | {("t2", 2)})


def test_title_matches_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["green", "tea", "and", "health", "oil", "of", "citrus"]
    say = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))
    pages = [(f"en/p{i}.md", say(), f"p{i}") for i in range(40)]
    titles = [(i, say().upper()) for i in range(15)]

    def score(title, page):
        path, name, stem = page
        norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
        a, fields = norm(title).split(), [norm(x).split() for x in (name, stem, path)]
        ratio = max(SequenceMatcher(None, a, x, autojunk=False).ratio() for x in fields)
        own, other = set(a), set(fields[0]) | set(fields[1])
        exact = 35 if norm(title) == norm(name) else 30 if norm(title) == norm(stem) else 0
        return min(ratio * 70 + len(own & other) / len(own) * 30 + exact, 100.0)

    want = {}
    for k, t in titles:
        ranked = sorted((-round(s, 2), p[0]) for p in pages if (s := score(t, p)) >= 30)
        want[k] = [(p, -s) for s, p in ranked[:5]]
    found = catalog.title_matches(spark.createDataFrame(pages, "path string, title string, stem string"), spark.createDataFrame(titles, "title_id long, wanted string")).orderBy("title_id", "rank").collect()
    got = {k: [(r.path, r.score) for r in found if r.title_id == k] for k, _ in titles}
    assert got == want


LONG = "A sentence that is told at some length. " * 30


def test_bodies_of_pages():
    body = lambda html: udfs.best_body(udfs._Tree(html).root)
    assert body(f"<body><nav>menu</nav><main>{LONG}</main><p>after</p></body>") == LONG.strip()
    assert body(f"<div class='x html-body'>{LONG} first</div><article>{LONG}</article>").endswith("first")
    assert body("<article>short</article><div id=content>also short</div><p>and more that is longer</p>") == "short also short and more that is longer"
    assert body(f"<body><div class='cookie-box'>{LONG}</div><figure><figcaption>c</figcaption>pic</figure>text</body>") == "pic text"
    assert body(f"<article>Please enable javascript. {LONG[:900]}</article><div class='entry-content'>{LONG}</div>") == LONG.strip()
    assert udfs.selector_texts("<p class='a b'>x</p><p class=b>y</p><p class=b>x</p>", ".b") == ["x", "y"] and udfs.selector_texts("<i role=main>m</i>", "[role=main]") == ["m"]


def test_few_pages_are_held_at_once(spark):
    pages = pa.array(["<title>t</title><h1>a</h1><p>x", None] * 500)
    for f in (udfs.page_parts, markdown.page_markdown):
        made = f.func(iter([pages]))
        assert [len(x) for x in made] == [min(udfs.PAGES, 1000 - at) for at in range(0, 1000, udfs.PAGES)]
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("<h1>"), F.col("id").cast("string"), F.lit("</h1>"))).alias("html")).coalesce(1)
    got = df.select("id", udfs.page_parts("html")["heading"].alias("h"), markdown.page_markdown("html").isNull().alias("none")).collect()
    assert [(r.h, r.none) for r in got] == [(None, True) if r.id % 2 else (str(r.id), False) for r in got] and len(got) == 1000


def test_leases_end_by_event_time(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    batches = [[(1, 1, "leased", at(0)), (2, 2, "leased", at(0)), (3, 3, "leased", at(0))], [(4, 2, "validated", at(30)), (5, 3, "scraping", at(50))], [(6, 9, "queued", at(200))], [(7, 9, "queued", at(201))], [(8, 9, "queued", at(202))]]
    schema = "event_id long, job_id long, to_state string, created_at timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.expired_leases(source, 3600, "10 minutes").writeStream.outputMode("append").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.job_id, r.state) for r in spark.table("leases").collect()} == {(1, "leased"), (3, "scraping")}
