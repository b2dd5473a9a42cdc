"""Byte-level BPE encoding and decoding by a rank file, with the tiktoken library.

Texts are cut at places that no match of PATTERN crosses (pieces.py), so another pattern must be cut there too.

Results for odd rows: a null or empty text has no ids; a very long text is encoded whole, its pieces in chunks;
no rows give no rows; repeated rows each get their own result; null ids stay; columns besides the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, workers_can_import
from .pieces import PieceTable

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Rows of a batch on the way back to Spark.
ROWS = 128
#: Pieces whose ids a worker keeps; the library is quick to find them again.
MOST = 1 << 18


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> PieceTable:
    return PieceTable(encoding(path, pattern).encode_ordinary, most=MOST)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col, ids: the ids of each whole text. path is opened on the executors, as installed files are.

    decoded: with what decode() would give, in the same Python workers, of which there are half as many then.
    """
    workers_can_import(docs.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, library = encoder(path, pattern), encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, counts = enc(part.column(1))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int32)))
                back = [pa.array([library.decode_bytes(found[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *back], names=[id_col, "ids", "decoded"][: 2 + decoded])
        give_back()

    source = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = [source.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.BinaryType())]
    return source.mapInArrow(run, T.StructType(schema[: 2 + decoded]))


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """The same rows with a column decoded: the raw bytes of the ids, which need not be whole characters."""
    workers_can_import(encoded.sparkSession)
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column(part.schema.get_field_index(ids_col))
                flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
                found = [enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
