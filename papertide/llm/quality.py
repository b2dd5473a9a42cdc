"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

Terms of a document: counts of trigrams of character classes and of hashed byte bigrams, of the whole
text. Their tf-idf vectors over a bounded sample of labelled rows give a truncated singular value decomposition;
a document's latent vector is its projection, with its shares of repeated words and lines beside it, scaled to
length one. The labelled vectors are broadcast: no more than 2 * PER_LABEL of them, of
DIMENSIONS + 3 numbers. Every document is compared with all of them, in blocks, by exact cosine; its
NEIGHBOURS most similar ones vote with their similarity.

Learning: rows whose crc32 of the id as text is divisible by 5 are held out; of the others,
the PER_LABEL of each label whose hashed id is least, so that the sample doesn't depend on order or
partitions. Ids with null, other or differing labels teach nothing.

Results for odd rows: a null or empty text has no terms and gets the share of good among the learned
labels; without any learned labels, as with no rows, all scores are 0.5; a very long text counts whole; of equally similar
neighbours those with the least ids vote; repeated rows each get their own result; columns
besides the id and the text are never read; score() keeps them, and its results are named by the caller.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, workers_can_import

PER_LABEL, DIMENSIONS, NEIGHBOURS, CUT = 1500, 48, 15, 0.3
CLASSES, BIGRAMS = 16**3, 2048
ROWS = 256


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"|", b"*#%&$@^~+=<>", b"'\"()[]{}`", b"-_/\\"), 1):
        out[list(chars)] = k
    out[0x80:0xA0], out[0xA0:0xC0], out[0xC0:] = 13, 14, 15  # of Latin letters with accents the first are capitals
    return out


_CLASS = _class_table()


def terms(text: str) -> np.ndarray:
    """Logarithms of the counts, and three shares: words equal to the one before, words and lines seen before."""
    raw = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(CLASSES + BIGRAMS + 3, np.float32)
    if len(raw) > 2:
        c = _CLASS[raw]
        out[:CLASSES] = np.bincount((c[:-2] << 8) | (c[1:-1] << 4) | c[2:], minlength=CLASSES)
        b = raw.astype(np.uint32)
        out[CLASSES : CLASSES + BIGRAMS] = np.bincount(((b[:-1] * 40_503 + b[1:] * 2_654_435_761) >> 16) % BIGRAMS, minlength=BIGRAMS)
        np.log1p(out, out=out)
    words, lines = text.split(), text.split("\n")
    if words:
        out[-3] = sum(map(str.__eq__, words, words[1:])) / len(words)
        out[-2] = 1 - len(set(words)) / len(words)
        out[-1] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, found: np.ndarray) -> np.ndarray:
        x = found[:, :-3] * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        y = np.concatenate([(x / np.where(norm > 0, norm, 1)) @ self.basis, found[:, -3:]], axis=1).astype(np.float64)
        y[norm[:, 0] == 0] = 0
        norm = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(norm > 0, norm, 1)

    def scores(self, found: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(found), self.prior)
        if not len(self.labels) or not len(found):
            return out
        x = self.latent(found)
        similar = x @ self.vectors.T
        k = min(k, len(self.labels))
        last = np.partition(similar, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
        above, equal = similar > last, similar == last
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(chosen, np.maximum(similar, 0), 0)
        total = weight.sum(axis=1)
        some = total > 0
        out[some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0, 1)


def fit(found: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """The decomposition, by a randomised range finder with power iterations."""
    if not len(labels):
        return Model(np.zeros(CLASSES + BIGRAMS, np.float32), np.zeros((CLASSES + BIGRAMS, 1), np.float32), np.zeros((0, 4)), np.zeros(0))
    counts = found[:, :-3]
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = counts * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)  # in place: the driver holds the sample's counts and this, no third copy
    q = np.random.default_rng(seed).standard_normal((x.shape[1], min(dimensions + 16, len(x)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    model = Model(idf, (q @ v.T)[:, :dimensions].astype(np.float32), np.zeros((0, 0)), labels.astype(np.float64))
    del x
    model.vectors = np.concatenate([model.latent(found[a : a + ROWS]) for a in range(0, len(found), ROWS)])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labels.quality, from at most per_label rows of each label."""
    workers_can_import(docs.sparkSession)
    clean = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"), F.max("quality").alias("__most"), F.count_if(F.col("quality").isNull()).alias("__nulls"))
    clean = clean.where((F.col("quality") == F.col("__most")) & (F.col("__nulls") == 0) & ~held_out(id_col))
    parts = [clean.where(F.col("quality") == q).orderBy(F.xxhash64(id_col), id_col).limit(per_label).select(id_col, "quality") for q in (0, 1)]
    sample = parts[0].unionAll(parts[1])  # no more than 2 * per_label rows
    rows = docs.select(id_col, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), id_col).select(id_col, "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zlib.compress(terms(x.as_py()).astype(np.float16).tobytes(), 1) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "quality", "terms"])

    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("quality", T.IntegerType()), T.StructField("terms", T.BinaryType())])
    # an id may stand in several rows; one of them is enough
    got = rows.withColumn("quality", F.col("quality").cast("int")).mapInArrow(run, schema).groupBy("id").agg(F.min(F.struct("terms", "quality")).alias("x")).select("id", "x.*").collect()
    got.sort(key=lambda r: r["id"])
    found = np.stack([np.frombuffer(zlib.decompress(r["terms"]), np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, CLASSES + BIGRAMS + 3), np.float32)
    model = fit(found, np.array([r["quality"] for r in got], np.float64))
    del found, got
    give_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The rows of docs with the score and whether it is at or above the cut, in columns of these names; all columns stay."""
    spark = docs.sparkSession
    if {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        raise ValueError(f"docs has a column of {names}: give other names")
    workers_can_import(spark)
    shared = spark.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                scores = model.scores(np.stack([terms(x.as_py() or "") for x in part.column(at_text)]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= cut).astype(np.int32))], names=[*part.schema.names, *names])
        give_back()

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
