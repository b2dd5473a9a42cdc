"""Byte-level BPE, token counts and token files against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from papertide.llm import bpe, pieces, simple8b, token_counts, token_files


@pytest.fixture(scope="module")
def tik():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hub():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


TEXTS = st.text(alphabet=st.sampled_from("ab Z9é中à\n\t '’s!.,<|\u00a0\u0085\x1c\u2003\u3000\u1680\u205f😀"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_join_and_encode_as_the_whole(text):
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    texts = [text, None, "", text[::-1], text]
    ids, counts = pieces.PieceTable(enc.encode_ordinary)(pa.array(texts, pa.string()).slice(0))
    want = [enc.encode_ordinary(x or "") for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.booleans())
def test_piece_encoding_of_the_tokenizers_library(text, special):
    text = text + "<|endoftext|>" + text if special else text
    tok = token_counts.tokenizer(P.path("byte_bpe_50k.json"))
    want = tok.encode(text, add_special_tokens=False).ids
    ids, counts = token_files._encoder(P.path("byte_bpe_50k.json"))(pa.array(["x", text, text]).slice(1))
    assert ids.tolist() == 2 * want and counts.tolist() == 2 * [len(want)]
    library = token_counts.Library(P.path("byte_bpe_50k.json"))
    found = library.matches(text) if text else []
    assert found is None or (found, sum(map(library.count, found))) == ([a for a in found if a], len(want))


def test_round_trip(docs, rows, tik):
    got = sorted(tuple(r) for r in bpe.round_trip(docs).collect())
    want = []
    for key, text, _ in rows:
        ids = tik.encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_decoding_raw_bytes(spark, tik):
    ids = tik.encode_ordinary("中😀")
    df = spark.createDataFrame([(1, ids[:1]), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df).collect()}
    assert got == {1: tik.decode_bytes(ids[:1]), 2: b""}


def test_token_counts(docs, rows, hub):
    got = sorted(tuple(r) for r in token_counts.over_limit(docs, 100).collect())
    want = []
    for key, text, _ in rows:
        n = len(hub.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 100))
    assert got == sorted(want)


def test_token_files(docs, rows, hub):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.written_and_read(docs).collect())
    assert [x[1] for x in got] == sorted(r[0] for r in rows)
    texts, start = {r[0]: r[1] for r in rows}, 0
    for at, key, n, crc in got:
        ids = np.array([*hub.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_rows(no_docs):
    assert bpe.round_trip(no_docs).count() == token_counts.over_limit(no_docs).count() == token_files.written_and_read(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.integers(0, 1), max_size=400), st.data())
def test_simple8b(values, data):
    ids = np.array(values, np.uint64)
    words, _, escapes = simple8b.pack(ids)
    assert (simple8b.unpack(words, len(ids), escapes) == ids).all()
    block = simple8b.write_block(ids, np.array([len(ids)], np.uint32))
    assert (simple8b.read_block(block)[0] == ids).all()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert (simple8b.read_ids(block, a, b) == ids[a:b]).all()


def test_small_ids_share_words():
    words, _, _ = simple8b.pack(np.ones(600, np.uint64))
    assert len(words) == 10


def test_a_table_that_starts_anew(tik, monkeypatch):
    monkeypatch.setattr(pieces.PieceTable, "CHUNK", 64)
    texts = [" ".join(f"w{i * 7 + k}ü" + "x" * (k % 20) for k in range(90)) for i in range(40)] * 2
    table = pieces.PieceTable(tik.encode_ordinary, most=128)
    ids, counts = table(pa.array(texts))
    assert ids.tolist() == sum(map(tik.encode_ordinary, texts), []) and counts.sum() == len(ids)
