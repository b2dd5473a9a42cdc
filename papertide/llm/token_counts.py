"""Token counts without token ids: each distinct pre-token is counted once, for the whole corpus.

1. One pass over the texts makes blocks of documents. A block has its postings, the pre-tokens of each
   document by number and how often they occur, and its vocabulary, in buckets by hash.
2. The parts are dealt out by bucket, so that equal pre-tokens meet; there, the tokenizers library counts
   each distinct one once. Even the most frequent pre-token stands only once in a block's vocabulary.
3. The counts, a number for each pre-token of a block, go back to its postings, and are summed by document.

Pre-tokens are the matches of the file's byte-level pattern. A piece of a text (pieces.py) beyond Latin, or with an added token in it, is
a unit of its own and counted by the whole tokenizer, as the library's own version of Unicode decides there.
The number of buckets grows with the texts' bytes; a task keeps the counts of one bucket, and starts anew when it holds MOST_KNOWN.

Results for odd rows: a null text counts as empty, with 0 bytes and 0 tokens; a text of a million
characters without white space is one pre-token; a very long text is a block of its own; repeated rows each get their own result; null ids stay; no rows
give no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_can_import
from .pieces import PieceTable

TOKENIZER = "byte_bpe_50k.json"
#: Documents and characters of a block at most; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 8192, 24_000_000
#: Texts looked at at once.
ROWS = 256
#: Buckets for each started BUCKET_INPUT bytes of text, at most MOST_BUCKETS; pre-tokens whose counts a task keeps.
BUCKETS, BUCKET_INPUT, MOST_BUCKETS, MOST_KNOWN = 1024, 1 << 37, 1 << 14, 2_000_000
#: Below it, letters and digits are the same for Python and the library, whatever their versions of Unicode.
_LATIN = "\u0250"
#: Fixed value: the pattern of the byte-level pre-tokenizer.
_MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def check_byte_level(path: str) -> None:
    """Pre-tokens can be counted on their own only if the file splits texts by the byte-level pattern and changes nothing before."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError(f"{path}: not a byte-level tokenizer without normalizer and prefix space")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens") or []):
        raise ValueError(f"{path}: its added tokens reach into the text around them")


def _alphabet() -> dict[int, int]:
    """Byte to the character that stands for it in a byte-level vocabulary: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_ALPHABET = _alphabet()
_SPACE = chr(_ALPHABET[32])


class Library:
    """What the library makes of single pieces. A Latin piece without an added token is split into the pattern's matches, each of which
    goes straight to the library's BPE model, past its pre-tokenizer; any other goes to the tokenizer whole."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model = self.tokenizer.model
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")

    def matches(self, piece: str) -> list[str] | None:
        if not piece.isascii() and max(piece) >= _LATIN or self.added.search(piece):
            return None
        at = 1 if piece[0] == " " else 0
        if piece[at:].isalpha():
            return [piece]
        return [piece[:-1], piece[-1]] if piece[-1] in ".,!?" and piece[at:-1].isalpha() else _MATCH.findall(piece)

    def _mapped(self, match: str) -> str | None:
        """What the model has for one match; None for a piece that the tokenizer must see whole."""
        if match.isascii() and match.isalnum() and not self.added.search(match):
            return match
        if match.isascii() and match[1:].isalnum() and match[0] == " " and not self.added.search(match):
            return _SPACE + match[1:]
        if not match.isascii() and max(match) >= _LATIN or self.added.search(match):
            return None
        return match.encode().decode("latin-1").translate(_ALPHABET)

    def __call__(self, match: str) -> list[int]:
        """The ids of one match, or of a piece for which there are none."""
        mapped = self._mapped(match)
        return self.tokenizer.encode(match, add_special_tokens=False).ids if mapped is None else [x.id for x in self.model.tokenize(mapped)]

    def count(self, match: str) -> int:
        mapped = self._mapped(match)
        return len(self.tokenizer.encode(match, add_special_tokens=False)) if mapped is None else len(self.model.tokenize(mapped))


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, by byte planes, as the high ones are mostly zero."""
    planes = np.ascontiguousarray(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _lengths_and_bytes(parts: list[bytes]) -> bytes:
    return zstandard.compress(len(parts).to_bytes(4, "little") + np.array([len(x) for x in parts], "<u4").tobytes() + b"".join(parts), 1)


def _parts(packed: bytes) -> list[bytes]:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.concatenate([[4 + 4 * n], np.frombuffer(raw, "<u4", n, 4)])).tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_NAMES = ["block", "deal", "bucket", "payload", "ids", "sizes"]


class _Block:
    """Postings and vocabulary of documents."""

    def __init__(self, number: int, library: Library, buckets: int):
        self.number, self.buckets, self.place = number, buckets, {}
        place = self.place
        self.table = PieceTable(lambda piece: [place.setdefault(x, len(place)) for x in library.matches(piece) or [piece]], most=1)
        self.ids, self.sizes, self.docs, self.which, self.often, self.bytes = [], [], [], [], [], 0

    def add(self, ids: list, texts: pa.Array, sizes: np.ndarray) -> None:
        numbers, counts = self.table(texts)
        docs = np.repeat(np.arange(len(ids), dtype=np.int64), counts)
        pairs, often = np.unique((docs << 32) | numbers, return_counts=True)
        self.docs.append((pairs >> 32) + len(self.ids))
        self.which.append(pairs & 0xFFFFFFFF)
        self.often.append(often)
        self.ids += ids
        self.sizes += sizes.tolist()
        self.bytes += int(sizes.sum())

    def rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        """The postings, as bucket -1, and the vocabulary by bucket."""
        vocabulary = [x.encode() for x in self.place]
        buckets = np.fromiter((zlib.crc32(x) % self.buckets for x in vocabulary), np.int64, len(vocabulary))
        order = np.argsort(buckets, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))  # numbers of pre-tokens in the order of buckets
        docs, ranks, often = np.concatenate(self.docs), rank[np.concatenate(self.which)], np.concatenate(self.often)
        by = np.argsort((docs << 32) | ranks)
        docs, ranks, often = docs[by], ranks[by], often[by]
        gaps = np.diff(ranks, prepend=0)
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        gaps[first] = ranks[first]  # gaps start anew with each document
        ends = np.searchsorted(buckets[order], np.arange(self.buckets + 1)).tolist()
        parts = [(b, [vocabulary[i] for i in order[x:y]]) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
        postings = [np.bincount(docs, minlength=len(self.ids)), gaps, often]
        payload = [_lengths_and_bytes([_packed(x) for x in postings]), *(_lengths_and_bytes(x) for _, x in parts)]
        deal = [self.buckets + self.number % 65_521, *(b for b, _ in parts)]
        rest = [None] * len(parts)
        arrays = [pa.array([self.number] * len(deal), pa.int64()), pa.array(deal, pa.int32()), pa.array([-1, *(b for b, _ in parts)], pa.int32()), pa.array(payload, pa.binary()), pa.array([self.ids, *rest], pa.list_(id_type)), pa.array([self.sizes, *rest], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _blocks(path: str, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(path)
        block = _Block(TaskContext.get().partitionId() << 24, library, n_buckets)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                if block.ids and (len(block.ids) + len(sizes) > BLOCK_DOCS or block.bytes + int(sizes.sum()) > BLOCK_BYTES):
                    yield block.rows(id_type)
                    block = _Block(block.number + 1, library, n_buckets)
                block.add(part.column(0).to_pylist(), part.column(1), sizes)
        if block.ids:
            yield block.rows(id_type)

    return run


def _finish(id_col: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows[rows["bucket"] >= 0].sort_values("bucket")["payload"]
        n = np.concatenate([_unpacked(x) for x in counts]) if len(counts) else np.zeros(0, np.int64)
        header = rows[rows["bucket"] < 0].iloc[0]
        lengths, gaps, often = (_unpacked(x) for x in _parts(header["payload"]))
        docs = np.repeat(np.arange(len(lengths)), lengths)
        run_on = np.cumsum(gaps)
        starts = np.cumsum(lengths) - lengths
        before = np.concatenate([[0], run_on])[starts]  # gaps start anew with each document
        total = np.bincount(docs, weights=n[run_on - before[docs]] * often, minlength=len(lengths)).astype(np.int64) if len(docs) else np.zeros(len(lengths), np.int64)
        return pd.DataFrame({id_col: pd.Series(list(header["ids"]), dtype=object), "n_bytes": np.asarray(header["sizes"], np.int64), "n_tokens": total})

    return run


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens of each row, as the tokenizers library has them without added tokens."""
    workers_can_import(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)
    check_byte_level(path)
    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_type = source.schema[0].dataType
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, BUCKETS * max(1, -(-total // BUCKET_INPUT)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, known, of = Library(path), {}, None
        for batch in batches:
            payload = []
            for bucket, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket < 0:
                    payload.append(packed)
                    continue
                if bucket != of or len(known) > MOST_KNOWN:
                    known, of = {}, bucket
                pieces = _parts(packed)
                for x in pieces:
                    if x not in known:
                        known[x] = library.count(x.decode())
                payload.append(_packed(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(payload, pa.binary()), batch.column(4), batch.column(5)], names=["block", "bucket", "payload", "ids", "sizes"])

    fields = {"block": T.LongType(), "deal": T.IntegerType(), "bucket": T.IntegerType(), "payload": T.BinaryType(), "ids": T.ArrayType(id_type), "sizes": T.ArrayType(T.LongType())}
    schema = T.StructType([T.StructField(k, v) for k, v in fields.items()])
    dealt = source.mapInArrow(_blocks(path, buckets), schema).repartition("deal").sortWithinPartitions("deal")
    counted = dealt.mapInArrow(count, T.StructType([x for x in schema if x.name != "deal"]))
    result = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return counted.groupBy("block").applyInPandas(_finish(id_col), result)


def over_limit(docs: DataFrame, limit: int = 1024) -> DataFrame:
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > limit)
