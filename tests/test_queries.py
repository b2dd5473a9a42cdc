"""Each query with SQL gives DuckDB's rows on the small tables, and more than none."""

import datetime as dt
import math
import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from papertide import queries

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return round(v, 6)
    return str(v)[:19] if isinstance(v, dt.datetime) else v


def rows(df):
    found = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, D).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)


def test_rows_only(spark):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, D).count()


def test_entry(spark):
    assert entry.entry(spark).count() and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_near_verbatim_compares_all_sentences(spark, tmp_path):
    rng, said = random.Random(3), [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(said) for _ in range(n)) + "."
    edit = lambda s: " ".join(w if rng.random() < 0.8 else rng.choice(said) for w in s[:-1].split()) + "."
    items = [(i, " ".join(say(rng.randint(4, 14)) for _ in range(3))) for i in range(8)]
    docs = [(k, " ".join([say(9), edit(items[k % 8][1].split(". ")[k % 3].rstrip(".") + "."), say(7)])) for k in range(40)] + [(90, None), (91, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda t: [x.strip(".").split() for x in (t or "").split(". ") if x.strip(".")]
    want = {}
    for k, t in docs:
        for i, u in items:
            best = max((round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 4) for x in cut(t) for y in cut(u)), default=0)
            if best >= 0.68:
                want[k, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.QUERIES["near_verbatim"](spark, str(tmp_path)).collect()}
    assert len(want) > 15 and got == want


PAGES = [
    (1, "http://a.org", "<html><head><title>Cut at its end &amp</title></head><body><article><h1>Cut &amp</h1><p>a &amp; b &lt;i&gt; &amp;lt; &quot;q&quot; &copy; &am " + "told on " * 120 + "</p></article></body></html>"),
    (2, "http://a.org", "<html><head><title>&quot;Said&quot; &amp;amp; &lt;b &copy &a</title></head><body><article><h1>x &quot</h1><p>" + "Long enough &amp; more. " * 60 + "&quo</p></article></body></html>"),
]


@pytest.mark.parametrize("name", ["page_entities", "page_bodies", "markdown_bodies"])
def test_entities_that_are_cut_stay(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(queries.SQL[name]).df())


def test_near_verbatim_exchanges_no_texts(spark, monkeypatch):
    from papertide.operators import verbatim

    rng, said = random.Random(5), [f"w{i}" for i in range(7)]
    say = lambda n: " ".join(rng.choice(said) for _ in range(n)) + "."
    items = spark.createDataFrame([(i, " ".join(say(rng.randint(1, 12)) for _ in range(3))) for i in range(12)] + [(90, None), (91, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(say(rng.randint(1, 14)) for _ in range(6))) for k in range(60)] + [(5, "again w1 w2."), (90, None), (None, say(5))], "id long, text string")
    found = verbatim.near(docs, items)
    assert "explode(sentences" not in found._jdf.queryExecution().executedPlan().toString()
    cut = lambda t: [x.strip(".").split() for x in (t or "").split(". ") if x.strip(".")]
    want = {}
    for k, t in docs.collect():
        for i, u in items.collect():
            best = max((round(SequenceMatcher(None, x, y, autojunk=False).ratio(), 4) for x in cut(t) for y in cut(u)), default=0)
            if best >= verbatim.LEAST:
                want[k, i] = max(best, want.get((k, i), 0))
    rows_of = lambda df: {(r.id, r.item_id): r.similarity for r in df.collect()}
    assert len(want) > 20 and rows_of(found) == want
    monkeypatch.setattr(verbatim, "KEPT", 2)
    assert rows_of(verbatim.near(docs, items)) == want
    monkeypatch.setattr(verbatim, "MOST", 5)  # more sentences than are sent to tasks
    assert rows_of(verbatim.near(docs, items)) == want
