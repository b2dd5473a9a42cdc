"""Operators that SQL can't express, and each stage of the pipeline, against plain recomputations on small tables."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from papertide.llm import bpe, hnsw, mixing, order_minhash, quality, sharding, syncmers, token_counts, token_files, url_filter

CLASHING = ("score", "predicted", "size", "taken", "words", "copy", "output", "target", "spans", "source_size", "row", "id", "n", "digest", "component", "key", "rule", "verdict", "path", "shard", "slot", "text_crc32", "n_tokens", "ids")


def with_clashes(df):
    return df.withColumns({c: F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col(df.columns[0]).cast("string"), F.lit("-"))) for c in CLASHING if c not in df.columns})


def texts(n: int = 90, seed: int = 11):
    """(doc_id, text, source) with near copies, equal rows, null and empty texts, null and repeated ids, one long text."""
    rng = random.Random(seed)
    say = lambda k: " ".join(f"w{rng.randrange(3000)}" for _ in range(k)).capitalize() + "."
    rows = [(i, say(rng.randint(30, 80)), f"s{i % 4}") for i in range(n)]
    for i in range(0, n, 6):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((1000 + i, " ".join(w), "s1"))
    rows += [(2000, None, "s0"), (2001, "", None), (2002, "  \n", "s2"), (2003, rows[4][1], "s3"), (2004, rows[4][1].upper(), ""), (2005, say(30_000), "s0"), (2006, rows[5][1], "s1"), (2006, rows[5][1], "s1"), (None, say(40), "s2"), (None, say(50), None), (7, say(45), "s0")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string, source string").repartition(3)


def as_rows(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_pieces_of_histogram_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_BYTES", 1000)
    rng = np.random.default_rng(5)
    rows = [(i, "w" * int(rng.integers(1, 300)) + str(i)) for i in range(3000)] + [(5000 + i, "one text " * 15) for i in range(40)] + [(9000, "long " * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (hashes[r[0]], r[0]))
    sizes = np.array([len(t.encode()) + 8 for _, t in order])
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.by_bytes(df).collect()}
    assert [got[k] for k, _ in order] == sorted(got.values())  # shards and slots follow the order of the keys
    ends, total = np.concatenate([[0], np.cumsum(sizes)]), int(sizes.sum())
    first = {s: i for i, s in reversed(list(enumerate(got[k][0] for k, _ in order)))}
    for s in range(1, 24):
        goal = total * s // 24
        nearest = int(np.abs(ends - goal).min())
        assert abs(int(ends[first[s]]) - goal) <= max(total / 24 * sharding.TOLERANCE, nearest)
    assert len({got[5000 + i][0] for i in range(40)}) == 1  # copies, as their group fits


def brute_mix(spark, rows, shards=mixing.OUTPUTS):
    """doc_id to (size, taken, {(output, copy): words}), by laying out each deck word by word."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, doc_id long, text string, source string")
    hashes = {r.i: r.h for r in df.select("i", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").alias("h")).collect()}
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    totals = {s: sum(size[i] for i in x) for s, x in by.items()}
    target = mixing.targets(totals)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    block = [max(1, totals[s] // mixing.BLOCKS) for s in names]
    quotas = [min(round(target[s] / b), int(mixing.MOST * totals[s]) // b) for s, b in zip(names, block, strict=True)]
    tree = mixing.split(np.array(quotas, np.int64), shards)
    out = {i: (size[i], 0, {}) for i in range(len(rows))}
    for k, s in enumerate(names):
        owner = np.repeat(np.arange(shards), tree[:, k] * block[k])
        bucket = {i: (hashes[i] % 2**64) >> (64 - mixing.BUCKET_BITS) for i in by[s]}
        key = "-" if s is None else "+" + s
        for copy in (0, 1):
            order = spark.createDataFrame([(key, copy, int(b)) for b in set(bucket.values())], "s string, c int, b long").select("b", F.xxhash64(F.lit(mixing.SEED), "s", "c", "b").alias("h")).collect()
            place = {r.b: (r.h, r.b) for r in order}
            at = copy * totals[s]
            for i in sorted(by[s], key=lambda i: (place[bucket[i]], hashes[i], (rows[i][0] is not None, rows[i][0] or 0))):
                mine = owner[at : at + size[i]]
                found = out[i][2]
                for o, n in zip(*np.unique(mine, return_counts=True), strict=True):
                    found[int(o), copy] = int(n)
                out[i] = (size[i], out[i][1] + len(mine), found)
                at += size[i]
    return out


def test_mixing_draws_the_blocks_that_the_tree_says(spark, table, monkeypatch):
    rows = texts()
    want = sorted((str(rows[i][0]), n, taken, sorted(x.items())) for i, (n, taken, x) in brute_mix(spark, rows).items())
    said = lambda df: sorted((str(r.doc_id), r["size"], r.taken, sorted(((x.output, x.copy), x.words) for x in r.shards)) for r in df.collect())
    got = said(mixing.taken(table))
    assert got == want
    real = mixing.split
    monkeypatch.setattr(mixing, "split", lambda q, n, seed=0: real(q, n, seed + 1))
    assert said(mixing.taken(table)) != want  # another tree gives other shards


def test_more_sources_than_one_draw_holds():
    quotas = np.full(130_000, min(mixing.BLOCKS, int(mixing.ALL_BLOCKS / 130_000 / mixing.MOST)), np.int64) * 2
    got = mixing.split(quotas, 4)
    assert (got.sum(axis=0) == quotas).all()


def test_mixing_keeps_columns_of_the_same_names(table):
    docs = with_clashes(table)
    drawn = mixing.draws(mixing.mix(docs))
    assert set(docs.columns) <= set(drawn.columns)
    assert all(r["size"].startswith("size of") and r.taken.startswith("taken of") for r in drawn.select(*docs.columns).collect())


def test_operators_ignore_columns_of_the_same_names(spark, table):
    docs = with_clashes(table)
    for run in (bpe.round_trip, sharding.by_bytes, token_files.written_and_read, mixing.taken, order_minhash.classes, syncmers.edited_likeness, token_counts.over_limit):
        assert run(docs).count() == len(texts()), run
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, labels).count() == len(texts())
    pages = spark.createDataFrame([(1, "http://a.net/" + "p" * 100_000), (None, None), (1, "http://a.net/x")], "page_id long, url string")
    got = url_filter.judge(with_clashes(pages)).collect()
    assert sorted(r.verdict for r in got) == ["allow", "block", "block"] and max(len(r.path) for r in got) == 100_001
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(str(r.n_links) for r in hnsw.classes(with_clashes(vectors)).collect()) == ["0", "1", "1"]


def test_recall_by_similarity():
    """Shares of pairs that meet in a sketch: a fifth or less of the words changed at random places."""
    rng, seen = random.Random(41), {}
    for n in (60, 200, 1000):
        for least in (0.8, 0.85, 0.9):
            met = 0
            for _ in range(100):
                a = np.array([rng.randrange(1 << 32) for _ in range(n)], np.uint32)
                b = a.copy()
                at = rng.sample(range(n), round(n * (1 - least)))
                b[at] = [rng.randrange(1 << 32) for _ in at]
                met += (order_minhash.sketches(a) == order_minhash.sketches(b)).any()
            seen[n, least] = met / 100
    print(seen)
    assert min(seen.values()) >= 0.9


def test_equal_votes_go_to_the_first():
    model = quality.Model(np.ones(4, np.float32), np.eye(4, dtype=np.float32), np.array([[1.0, 0, 0, 0, 0, 0, 0]] * 6), np.array([1.0, 0, 1, 0, 0, 0]))
    model.latent = lambda found: np.array([[1.0, 0, 0, 0, 0, 0, 0]] * len(found))
    assert model.scores(np.zeros((2, 7)), k=3).tolist() == [2 / 3, 2 / 3]


def alike(a, b):
    x, y = (order_minhash.words(t or "").tolist() for t in (a, b))
    if not x or not y:
        return False
    prev = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        cur = [i]
        for j, v in enumerate(y, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (u != v)))
        prev = cur
    return prev[-1] <= int(max(len(x), len(y)) * 0.2 + 1e-9)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    with_clashes(spark.createDataFrame(texts(), "doc_id long, text string, source string")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = as_rows(docs)
    # 1: the votes of the most similar learned documents
    model = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = []
    for r in rows:
        x = model.latent(quality.terms(r[1] or "")[None, :])[0]
        sims = [float(x @ v) for v in model.vectors]
        near = sorted(range(len(sims)), key=lambda k: (-sims[k], k))[: quality.NEIGHBOURS]
        weight = [max(sims[k], 0) for k in near]
        score = sum(w * model.labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight) if sum(weight) > 0 else model.prior
        assert abs(score - quality.CUT) > 1e-6
        good += [r] if score >= quality.CUT else []
    kept = corpus_pipeline.keep_good(spark, docs, folder)
    assert kept.columns == docs.columns and as_rows(kept) == good
    # 2: one of each class of texts that are alike
    short = [i for i, r in enumerate(good) if len(r[1] or "") < 5000]
    root = list(range(len(good)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in short:
        for j in short:
            if i < j and 0.5 < (len(good[i][1] or "") + 1) / (len(good[j][1] or "") + 1) < 2 and (good[i] == good[j] or alike(good[i][1], good[j][1])):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, r in enumerate(good):
        groups[find(i)].append(r)
    one = corpus_pipeline.keep_one_of_each(spark, kept, folder)
    least = sorted((min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()))
    assert one.columns == docs.columns and sorted((r[0] is None, r[0] or 0) for r in as_rows(one)) == least
    one = one.checkpoint()
    # 3: whole documents, of which half or more lies in the blocks that are drawn
    left = as_rows(one)
    want = []
    size_of_source = defaultdict(int)
    mixed = brute_mix(spark, left)
    for i, (n, _, _) in mixed.items():
        size_of_source[left[i][2]] += n
    for i, (n, _, spans) in mixed.items():
        for copy in (0, 1):
            if n and 2 * sum(w for (_, c), w in spans.items() if c == copy) >= n:
                want.append(left[i])
    drawn = corpus_pipeline.mix_sources(spark, one, folder)
    assert drawn.columns == docs.columns
    got = as_rows(drawn)
    assert [r for r in got if re.findall(mixing.WORD, r[1] or "")] == sorted(want, key=str)
    assert {r for r in got if not re.findall(mixing.WORD, r[1] or "")} <= {r for r in left if not re.findall(mixing.WORD, r[1] or "")}
    # 4: ids and bytes as the library has them
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tik = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.to_token_ids(spark, drawn, folder).collect()
    said = sorted((str(r.doc_id), list(r.ids), r.n_tokens, r.decoded_sha256) for r in out)
    assert said == sorted((str(k), ids := tik.encode_ordinary(t or ""), len(ids), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in got)


def test_pipeline_runs_on_odd_rows(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 50
