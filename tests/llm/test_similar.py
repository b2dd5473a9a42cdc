import hashlib
import random

import numpy as np
import pytest

from papertide.llm import components, hnsw, order_minhash, quality, syncmers


def closure(pairs, keys):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    keys = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == closure([p for p in pairs if p[0] != p[1]], keys)


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_banded_distance_is_exact_inside_the_band():
    rng = random.Random(2)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(30))]
        b = a[: rng.randrange(len(a) + 1)] + [rng.randrange(4) for _ in range(rng.randrange(8))] + a[rng.randrange(len(a) + 1) :]
        for most in (1, 3, 10, 70):
            assert order_minhash.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(dp(a, b), most + 1)


def test_near_duplicates(docs, rows, no_docs):
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    w = {k: order_minhash.words(t or "").tolist() for k, t, _ in rows}
    keys = [k for k in w if w[k]]
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if 0.7 < len(w[a]) / len(w[b]) < 1.4 and (w[a] == w[b] or (len(w[a]) < 500 and dp(w[a], w[b]) <= 0.2 * max(len(w[a]), len(w[b]))))]
    assert got == closure(pairs, list(w))
    assert got[105] == 3 and got[106] == 7 and got[100] == 100 and got[101] == 101
    assert order_minhash.classes(no_docs).count() == 0


def test_keep_one(docs, rows):
    kept = order_minhash.keep_one(docs)
    ids = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids == sorted({r[0] for r in rows} - {104, 105, 106, 111})


def test_ids_that_name_no_text(spark):
    rng = random.Random(31)
    say = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    texts = [say() for _ in range(10)]
    rows = [(None, x) for x in texts[:5]] + [(7, x) for x in texts[5:]] + [(7, texts[5]), (7, texts[6].upper()), (None, texts[7]), (3, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text.lower() for r in order_minhash.keep_one(docs).collect()) == sorted(texts)
    got = order_minhash.classes(docs).collect()
    assert len(got) == len(rows) and len({r.class_key for r in got}) == 10
    assert sum(r.kept for r in got) == 11  # both of the rows that are equal


def test_a_hot_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(6):
            text[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(150)) + " " + " ".join(base[:40])) for i in range(60)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 1000 else k for k, _ in rows}


def test_copies_that_are_like_the_original_only(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 201):
        text = list(base)
        for at in rng.sample(range(300), 42):
            text[at] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    w = {k: order_minhash.words(t) for k, t in rows}
    assert all(order_minhash.similar(w[0], w[k]) for k in w) and sum(order_minhash.similar(w[k], w[k + 1]) for k in range(1, 200)) < 10
    keys = {k: set(order_minhash.sketches(x).tolist()) for k, x in w.items()}
    pairs = [(a, b) for a in w for b in w if a < b and keys[a] & keys[b] and order_minhash.similar(w[a], w[b])]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == closure(pairs, list(w)) and sum(x == 0 for x in got.values()) >= 195


def test_lengths_leave_the_recall_alone():
    rng, found, whole, even = random.Random(21), 0, 0, 0
    for _ in range(200):
        a = np.array([rng.randrange(1 << 32) for _ in range(300)], np.uint32)
        b = a[sorted(rng.sample(range(300), 240))]
        c = a.copy()
        at = rng.sample(range(300), 60)
        c[at] = [rng.randrange(1 << 32) for _ in at]
        share = len(np.intersect1d(order_minhash.kmers(a), order_minhash.kmers(b))) / len(np.union1d(order_minhash.kmers(a), order_minhash.kmers(b)))
        assert share < 0.4 and order_minhash.similar(a, b)
        met = (order_minhash.sketches(a) == order_minhash.sketches(b)).sum()
        found, whole = found + (met > 0), whole + met
        even += (order_minhash.sketches(a) == order_minhash.sketches(c)).any()
    print("recall at length ratio 0.8:", found / 200, "of equal lengths:", even / 200, "sketches met:", whole / 200)
    assert found >= 0.85 * 200


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.12 * rng.standard_normal(16)).tolist(), i % 2) for i in range(600)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(300)]  # copies, a third of all
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [], 0), (2006, rows[1][1][:8], 1), (2007, [float("inf")] * 16, 1)]
    return rows


@pytest.mark.parametrize("shard_points", [4096, 90])
def test_vectors(spark, shard_points):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, links string")
    audits = []
    got = {r.vec_id: tuple(r)[1:] for r in hnsw.near_duplicates(df, shard_points=shard_points, audits=audits).collect()}
    assert audits[0][0] > 500 and audits[0][1] >= hnsw.RECALL * audits[0][0]
    good = {k: (np.array(v) / np.linalg.norm(v), lab) for k, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    pairs = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    n, comp = dict.fromkeys([r[0] for r in rows], 0), closure(pairs, [r[0] for r in rows])
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    want = {k: (n[k], comp[k], comp[k] == k) for k in n}
    wrong = [k for k in want if got[k] != want[k]]
    assert len(pairs) > 1000 and sum(got[k][0] for k in n) >= hnsw.RECALL * sum(n.values()) and len(wrong) <= 0.005 * len(rows)
    assert all(got[k] == (0, k, True) for k in range(2000, 2008))


def test_no_vectors(spark):
    assert hnsw.classes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_syncmers(text, k=syncmers.K, s=syncmers.S):
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = []
    for i in range(len(chars) - k + 1):
        inner = []
        for j in range(k - s + 1):
            h = 0
            for c in chars[i + j : i + j + s].tolist():
                h = (h * int(syncmers._M) + c + 1) % 2**64
            inner.append(int(syncmers._mixed(np.array([h], np.uint64))[0]))
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_syncmers_are_closed_and_free_of_context():
    text = "The quick brown fox jumps over the lazy dog; čtyři 中文字符 and more of the same, the same."
    h, at = syncmers.syncmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert at.tolist() == brute_syncmers(text)
    h2, at2 = syncmers.syncmers(np.frombuffer(("xyz" + text).encode("utf-32-le"), np.uint32))
    assert set(zip((at + 3).tolist(), h.tolist(), strict=True)) <= set(zip(at2.tolist(), h2.tolist(), strict=True))


def test_fingerprints(docs, rows, no_docs):
    got = syncmers.edited_likeness(docs).collect()
    order = sorted(rows, key=lambda r: -r[0])
    texts = {r[0]: r[1] or "" for r in rows}
    after = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    after[111] = None  # one of the two equal rows has the other next
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    for r in got:
        text, mine = texts[r.doc_id], syncmers.anchors(texts[r.doc_id])
        assert r.n_chars == len(text) and r.fingerprint == syncmers.to_string(mine)
        half = len(text) // 2
        options = [after[r.doc_id]] if after[r.doc_id] is not None else [texts[111], texts[110]]
        edits = {hashlib.sha256((e := text[: len(text) - half] + o[:half]).encode()).hexdigest(): (e, o) for o in options}
        edited, other = edits[r.edited_sha256]
        assert r.edited_fingerprint == syncmers.to_string(syncmers.anchors(edited))
        assert r.near_edited == syncmers.likeness(mine, syncmers.anchors(edited)) and r.near_next == syncmers.likeness(mine, syncmers.anchors(other))
    assert syncmers.edited_likeness(no_docs).count() == 0
    assert {r.doc_id: r.fingerprint for r in syncmers.fingerprints(docs).collect()}[104] == next(r.fingerprint for r in got if r.doc_id == 3)


def test_a_fingerprint_holds_every_syncmer():
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = say(40)
    a, b = (say(4000) + " " + passage + " " + say(4000) for _ in range(2))
    found = syncmers.anchors(a)
    assert found[1].tolist() == brute_syncmers(a[:3000]) + found[1][len(brute_syncmers(a[:3000])) :].tolist() and len(found[0]) > 0.1 * len(a)
    both = syncmers.from_string(syncmers.to_string(found))
    assert (both[0] == found[0]).all() and (both[1] == found[1]).all()
    start, ours = a.index(passage), syncmers.anchors(passage)[0].tolist()
    other = set(syncmers.anchors(b)[0].tolist())
    assert len(ours) > 20 and set(ours) <= other and set(ours) <= {h for h, p in zip(*(x.tolist() for x in found), strict=True) if p >= start}
    assert syncmers.likeness(found, syncmers.anchors(b)) >= len(ours) / (2 * len(found[0]) + 1000)
    twice = syncmers.anchors(passage + " " + passage)
    assert sum(h == ours[3] for h in twice[0].tolist()) == 2 and 0.4 < syncmers.likeness(syncmers.anchors(passage), twice) < 0.5
    assert syncmers.likeness(twice, twice) == 1.0


def test_windows_change_nothing(monkeypatch):
    text = " ".join(f"word{i * i % 977}" for i in range(900))
    want = syncmers.anchors(text)
    monkeypatch.setattr(syncmers, "WINDOW", 301)
    got = syncmers.anchors(text)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "lies", "under", "quiet"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "***", "CHEAP!!"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(400)] + [(900, None), (901, ""), (902, good() * 400), (5, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)] + [(9, None, 0), (13, 1, 0), (13, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id): r for r in quality.judged(docs, labels).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    assert sum(got[i].predicted == int(i % 4 > 0) for i in range(400) if i != 5) >= 395
    assert got[900].score == got[901].score and got[902].predicted == 1
    model = quality.learn(docs, labels)
    assert len(model.labels) <= 2 * quality.PER_LABEL
    none = quality.judged(docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r.score == 0.5 for r in none)
    assert quality.judged(docs.limit(0), labels).count() == 0


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    found = np.abs(rng.standard_normal((50, quality.CLASSES + quality.BIGRAMS + 3))).astype(np.float32)
    model = quality.fit(found[:40], (np.arange(40) % 2).astype(float))
    x = model.latent(found[40:])
    for i, s in enumerate(model.scores(found[40:])):
        sims = model.vectors @ x[i]
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0)
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-9


def test_blocks_find_all_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK", 7)
    rng = random.Random(17)
    said = [rng.randrange(1 << 32) for _ in range(40)]
    words = []
    for i in range(60):
        w = [rng.choice(said[: 5 + i % 30]) for _ in range(rng.randint(6, 40))] if i % 3 or not words else list(words[-1])
        if i % 3 == 0:
            w[rng.randrange(len(w))] = 1
        words.append(w)
    words += [[7] * 300, [7] * 310, [8] * 300, [7] * 290 + [8] * 15]
    arrays = [np.array(w, np.uint64) for w in words]
    rows = [(i, i if i % 10 else 0, len(w), order_minhash.packed(w)) for i, w in enumerate(arrays)]
    got = list(map(tuple, order_minhash._similar_in_blocks(spark.createDataFrame(rows, "n long, component long, size long, words binary"), 0.8).collect()))
    want = [(j, i) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][1] != rows[j][1] and dp(words[i], words[j]) <= int(max(len(words[i]), len(words[j])) * 0.2 + 1e-9)]
    same = [(i, c) for i, c, *_ in rows]
    # links that join what the similar pairs join, and are similar pairs all
    assert set(got) <= set(want) and len(want) > 10 and len(got) < len(want)
    assert closure(got + same, range(len(rows))) == closure(want + same, range(len(rows)))


def test_texts_of_other_words_stay_apart(spark):
    """Words that agree in 31 bits of a hash are two words, also where they are a whole text."""
    rows = [(1, "word48216"), (2, "word81465"), (3, "Word48216."), (4, "word48216 a"), (5, "a b c d"), (6, "a b c e")]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}


@pytest.mark.parametrize("n", [5, 8, 10, 15, 20, 30, 39])
def test_short_pairs_all_meet(spark, n, monkeypatch):
    """Each similar pair of short texts is found, whatever its edits, also where words are often among the rarest ones."""
    monkeypatch.setattr(order_minhash, "RARE", 4)
    rng, said = random.Random(n), [f"w{i}" for i in range(600)]
    rows, edits = [], int(n * 0.2 + 1e-9)
    for i in range(60):
        text = [rng.choice(said) for _ in range(n)]
        rows.append((3 * i, " ".join(text)))
        near = list(text)
        for at in rng.sample(range(n), edits):
            near[at] = rng.choice(said)
        rows.append((3 * i + 1, " ".join(near)))
        even = list(text)
        for at in range(4, n, 5):  # every fifth word
            even[at] = f"x{i} "[:-1]
        rows.append((3 * i + 2, " ".join(even)))
    # texts that say nearly the same, so that their rarest words are everyone's
    common = [rng.choice(said) for _ in range(n)]
    for i in range(40):
        text = list(common)
        text[rng.randrange(n)] = f"y{i}"
        rows.append((1000 + i, " ".join(text)))
    w = {k: order_minhash.words(t) for k, t in rows}
    pairs = [(a, b) for a in w for b in w if a < b and order_minhash.similar(w[a], w[b])]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == closure(pairs, list(w)) and len(pairs) > 60


def test_pairs_across_the_border_of_short_texts_meet(spark):
    rng = random.Random(8)
    rows = []
    for i in range(80):
        text = [f"v{rng.randrange(3000)}" for _ in range(48)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(x for k, x in enumerate(text) if k % 5 != 4 or k > 44))]
    w = {k: order_minhash.words(t) for k, t in rows}
    assert {len(x) for x in w.values()} == {39, 48}
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(80))


def test_words_of_one_component_make_no_rows(spark):
    from papertide.llm import order_minhash as m

    rng = random.Random(4)
    own = lambda k: [f"o{k}x{i}" for i in range(40)]
    shared, group = [f"s{i}" for i in range(20)], [f"g{i}" for i in range(40)]
    # texts that share a passage only, and a group of one component with words of its own
    texts = [(k, own(k) + shared, k) for k in range(30)] + [(100 + k, rng.sample(group, 40) + shared, 100) for k in range(30)]
    rows_of = [(n, bytes(m.packed(m.words(" ".join(w)))), c) for n, w, c in texts]
    made = m._rare_words(spark.createDataFrame(rows_of, "n long, words binary, component long"), 0.8).collect()
    assert len(made) == 60 and sum(len(r.tokens) for r in made) <= 30  # but for words that share a slot; a row for each of 13 words before


def test_words_that_lead_nowhere_make_no_rows(spark, monkeypatch):
    """Words of more than RARE texts, and words of texts whose lengths exclude each other, are no rows; the classes are those of all pairs."""
    rng = random.Random(17)
    new = iter(range(10**6))
    passage = [f"p{i}" for i in range(12)]
    blocks = [[f"b{k}x{i}" for i in range(10)] for k in range(7)]
    # a group that says the same in another order, and its near copies
    say = lambda: [w for b in rng.sample(blocks, 7) for w in b] + [f"u{next(new)}" for _ in range(8)]
    texts = [passage + say() for _ in range(90)]
    texts += [t[:20] + [f"e{next(new)}"] + t[21:] for t in texts[:20]]
    # and pairs that share rare words, of lengths that allow them to be similar or don't
    for k in range(40):
        own = [f"o{k}x{i}" for i in range(60)]
        texts += [passage + own, passage + (own[:30] + [f"c{next(new)}"] + own[31:] if k % 2 else own[:20] + [f"c{next(new)}" for _ in range(200)])]
    words = [order_minhash.words(" ".join(t)) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if order_minhash.similar(words[i], words[j])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    made, cut = [], order_minhash.cut

    def seen(df):
        out = cut(df)
        if out.columns == ["n", "token"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(order_minhash, "cut", seen)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert pairs and got == closure(pairs, range(len(texts)))
    assert len(made) == 1 and made[0] < 400


def test_texts_are_read_once_for_all_rounds(spark):
    """Their words are kept for the comparisons; reading each text again for each round of them took more than its share at 6 GB."""
    rng = random.Random(23)
    texts = [[f"w{rng.randrange(3000)}" for _ in range(60)] for _ in range(40)]
    texts += [t[:30] + ["other"] + t[31:] for t in texts[:20]] + [t[:12] for t in texts[:9]] + [t[:11] + ["other"] for t in texts[:9]]
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for part in rows:
            reads.add(part.num_rows)
            yield part

    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).mapInArrow(seen, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    words = [order_minhash.words(" ".join(t)) for t in texts]
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if order_minhash.similar(words[i], words[j])]
    assert len(pairs) == 29 and got == closure(pairs, range(len(texts)))
    assert reads.value == len(texts)


def test_marked_rows(spark):
    """Numbers are found by their bits, at the borders of bytes and of buckets as well."""
    every = [p << 33 | i for p in (0, 1, 70_000) for i in (0, 1, 2, 7, 8, 9, 32_766, 32_767, 32_768, 32_769, 65_536, 65_537, 1 << 32)]
    chosen = every[::3] + every[1:9]
    rows, numbers = (spark.createDataFrame([(n, str(n)) for n in x], "n long, x string") for x in (every, [*chosen, *chosen[:4], 5]))
    got = order_minhash._having(rows, order_minhash._marked(numbers)).collect()
    assert sorted(map(tuple, got)) == sorted((n, str(n)) for n in set(chosen))


def test_batches_of_texts_are_texts_one_by_one():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, most, n).astype(np.uint64) for n in (40, 41, 60, 400) for most in (2, 30, 1 << 40)]
    counts, joined = np.array([len(w) for w in texts]), np.concatenate(texts)
    assert (order_minhash._all_sketches(joined, counts) == [order_minhash.sketches(w) for w in texts]).all()
    assert (order_minhash._all_marks(joined, counts) == [order_minhash.marks(w) for w in texts]).all()


def test_similar_is_the_edit_distance_for_any_numbers():
    """Numbers beyond the bits of a word, repeated ones, and other orders."""
    rng = random.Random(29)
    seen = set()
    for _ in range(600):
        most = rng.choice([3, 12, 1 << 40, 1 << 64])
        a = [rng.randrange(most) for _ in range(rng.randint(1, 50))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randrange(most)] * rng.randint(0, 1)
        if rng.random() < 0.1:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        got = order_minhash.similar(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == (dp(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9))
        seen.add(got)
    assert len(seen) == 2
