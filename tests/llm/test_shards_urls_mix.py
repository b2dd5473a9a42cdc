import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertide.llm import mixing, sharding, url_filter


def test_shards_are_even_gapless_and_keep_copies_together(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w" * int(rng.integers(1, 400)) + str(i)) for i in range(4000)]
    rows += [(5000 + i, "copy of one text " * 20) for i in range(2000)]  # a third of all rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.by_bytes(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    size, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) - min(size.values()) <= 2 * 0.001 * mean + 420
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_odd_rows(docs, rows, no_docs):
    got = sharding.by_bytes(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert next(r for r in got if r.doc_id == 100)["size"] == 8
    assert sharding.by_bytes(no_docs).count() == 0


def test_equal_rows_in_every_key(spark):
    df = spark.createDataFrame([(1, "same")] * 480, "doc_id long, text string").repartition(3)
    got = sharding.by_bytes(df).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [20] * 24


def brute_judge(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


URLS = [None, "", "nothing", "http://", "http://NET/", "https://a.B.net/x?y#z", "http://net", "x://example.net/en/a", "x://EXAMPLE.net/en", "http://sub.example.com/de/ü", "http://org/fr/", "http://ÄB.org/fr/1", "http://a.org#/fr/", "http://a?b/c://d.net/", "http://u:p@x.net:80/"]


def test_urls(spark):
    rows = [(i, u, "e") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(tuple(r) for r in url_filter.judge(df).collect())
    assert got == [(i, *brute_judge(u, url_filter.RULES)) for i, u, _ in rows]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_many_rules(tmp_path):
    rng = np.random.default_rng(0)
    rules = sorted({("block" if int(rng.integers(2)) else "allow", f"h{int(rng.integers(60))}.t{int(rng.integers(5))}", "/" * int(rng.integers(2)) + "p" * 0) for _ in range(300)}, key=lambda r: r[1:])
    rules = list({r[1:]: r for r in rules}.values())
    (tmp_path / "index").write_bytes(url_filter.build(rules))
    index = url_filter.Index(str(tmp_path / "index"))
    hosts = [f"x.h{i % 70}.t{i % 7}" for i in range(500)]
    got = index.judge(hosts, ["/q"] * 500)
    want = [brute_judge(f"a://{h}/q", rules, None)[2:] for h in hosts]
    assert list(zip(*got, strict=True)) == want
    with pytest.raises(ValueError):
        url_filter.build([("block", "a", "/"), ("allow", "a", "/")])


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(docs, rows, no_docs):
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, size = {r[0]: r[2] for r in rows}, defaultdict(int)
    for _, text, s in rows:
        size[s] += words(text)
    target, taken = brute_targets(size), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 + size[s] / mixing.BLOCKS for s in size)
    assert mixing.taken(no_docs).count() == 0


def test_splitting_tree_keeps_quotas():
    got = mixing.split(np.array([1000, 0, 7]), 13)
    assert got.shape == (13, 3) and (got.sum(axis=0) == [1000, 0, 7]).all() and (got >= 0).all()
    assert abs(int(got.sum(axis=1).max()) - int(got.sum(axis=1).min())) <= 4


def test_draws_repeat_rows_as_often_as_taken(docs):
    mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    drawn = mixing.draws(mixed, whole=False).groupBy("doc_id").agg(F.sum("__mix_words").alias("w")).where("w > 0")
    want = {r.doc_id: r.t for r in mixed.groupBy("doc_id").agg(F.sum("__mix_taken").alias("t")).where("t > 0").collect()}
    assert {r.doc_id: r.w for r in drawn.collect()} == want
