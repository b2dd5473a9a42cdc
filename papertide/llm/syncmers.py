"""Fingerprints of closed syncmers.

A k-mer of a text's code points is a closed syncmer if the least hash among its s-mers is that of the first
or the last one. Whether it is depends on its own characters alone, so shared passages give the same
anchors wherever they stand. A fingerprint holds every syncmer of the text, repeated ones too,
in the order of the text, each as hash:place in hexadecimal.

The likeness of two fingerprints: of the anchors of both together, the share that both have in
the same order (the longest chain of common anchors whose places rise in both). The n-th anchor of a hash in one
is the n-th of that hash in the other.

Results for odd rows: a null or empty text has the empty fingerprint, which is like itself (1) and unlike
any other (0); a text shorter than k, or with no syncmer, has one anchor, its whole text's hash; a very long text is worked through in
windows, and keeps all its anchors; of equal hashes in one window each end that holds the least counts; equal texts
have equal fingerprints, repeated rows each their own result; no rows give no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_at_most, workers_can_import

K, S = 20, 6
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Characters hashed at once: long texts are worked through in overlapping windows.
WINDOW = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def syncmers(chars: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of a text's closed syncmers, in order."""
    if len(chars) < k:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    c = chars.astype(np.uint64) + np.uint64(1)
    n = len(c) - s + 1
    h = c[:n]
    for j in range(1, s):
        h = h * _M + c[j : j + n]
    h = _mixed(h)
    w = k - s + 1
    least, size = h, 1
    while size < w:
        step = min(size, w - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    at = np.flatnonzero((h[: len(least)] == least) | (h[w - 1 :] == least))
    g = c[at]
    for j in range(1, k):
        g = g * _M + c[at + j]
    return (_mixed(g) >> np.uint64(32)).astype(np.uint32), at


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a fingerprint's anchors, in order of the text."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hashes, places = [], []
    for at in range(0, max(1, len(chars) - k + 1), WINDOW):
        h, p = syncmers(chars[at : at + WINDOW + k - 1], k, s)
        hashes.append(h)
        places.append(p + at)
    h, p = np.concatenate(hashes), np.concatenate(places)
    if not len(h):
        return np.array([xxhash.xxh32_intdigest(text.encode())], np.uint32), np.zeros(1, np.int64)
    return h, p


def to_string(found: tuple[np.ndarray, np.ndarray]) -> str:
    return ("%08x:%x," * len(found[0]) % tuple(np.column_stack([found[0].astype(np.int64), found[1]]).ravel().tolist()))[:-1]


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = [x.split(":") for x in fingerprint.split(",")] if fingerprint else []
    return np.array([int(h, 16) for h, _ in pairs], np.uint32), np.array([int(p, 16) for _, p in pairs], np.int64)


def _labelled(h: np.ndarray) -> np.ndarray:
    """The hashes, each with the number of its occurrence."""
    order = np.argsort(h, kind="stable")
    at = np.arange(len(h))
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return (h.astype(np.uint64) << np.uint64(32)) | occurrence


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common, i, j = np.intersect1d(_labelled(a[0]), _labelled(b[0]), assume_unique=True, return_indices=True)
    places = b[1][j[np.argsort(i)]]  # in order of a's places
    both, chain = len(a[0]) + len(b[0]) - len(common), len(common)
    if (places[1:] <= places[:-1]).any():
        ends: list[int] = []
        for place in places.tolist():
            at = bisect_left(ends, place)
            ends[at : at + 1] = [place]
        chain = len(ends)
    return chain / both


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint of each row."""
    workers_can_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_string(anchors(x.as_py() or "")) for x in part.column(1)], pa.string())], names=[id_col, "fingerprint"])

    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return source.mapInArrow(run, T.StructType([source.schema[0], T.StructField("fingerprint", T.StringType())]))


#: Fingerprints given to Spark at once.
BATCH_BYTES = 16 << 20
#: Rows are dealt to at least so many ranges of ids, and more so that a range has no more bytes; at most MOST_RANGES.
RANGES, RANGE_BYTES, MOST_RANGES = 64, 32 << 20, 8192


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document against its edited text, whose second half is the next document's start, and against the next one.

    Next: in descending order of doc_id, equal ids in order of their text's hash, null ids last; after the
    last comes the first. The documents are exchanged once, by ranges of ids; the first row of each range
    goes to the range before as well, where it is only looked at.
    """
    workers_can_import(docs.sparkSession)
    lowest = -(1 << 63)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)), "h": F.xxhash64("text")})
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(RANGES, min(MOST_RANGES, total // RANGE_BYTES))
    bounds = source.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    # range 0 holds the greatest ids
    ranged = source.withColumn("part", F.lit(len(bounds)) - count_at_most(F.col("k"), bounds))
    heads = ranged.groupBy("part").agg(F.max(F.struct(F.col("k"), (-F.col("h").cast("decimal(20,0)")).alias("h"))).alias("x")).select("part", "x.k", "x.h").collect()
    heads.sort(key=lambda r: r["part"])  # one row for each range
    table = [(r["part"], r["k"], int(-r["h"]), heads[i - 1]["part"]) for i, r in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(table, "part int, head_k long, head_h long, before int")
    joined = ranged.join(F.broadcast(first), "part")
    own = F.struct(F.col("part"), F.lit(0).alias("guest"))
    guest = F.when((F.col("k") == F.col("head_k")) & (F.col("h") == F.col("head_h")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))
    dealt = joined.select("doc_id", "text", "k", "h", F.explode(F.array_compact(F.array(own, guest))).alias("x")).select("x.part", "x.guest", "k", "h", "doc_id", "text")
    # a range is a partition, not the hash of one, so that no task has several
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "guest", F.col("k").desc(), "h").select("part", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, out, size, id_type = None, [], 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(2).type
            for part, is_guest, key, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = (part, key, text, anchors(text))
                if held is not None and held[0] == part:
                    half = len(held[2]) // 2
                    edited = held[2][: len(held[2]) - half] + text[:half]
                    mine = anchors(edited)
                    out.append((held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), to_string(held[3]), to_string(mine), likeness(held[3], mine), likeness(held[3], own[3])))
                    size += len(out[-1][3]) + len(out[-1][4])
                held = None if is_guest else own  # after a guest its range is done
                if len(out) >= 256 or size >= BATCH_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    text = [T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), *text, T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    return dealt.mapInArrow(run, schema)
