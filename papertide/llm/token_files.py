"""Token ids in files, in ascending order of document, coded by Simple-8b.

The files are a Parquet table in the shared folder, written by Spark and so committed once however often
tasks are retried: a row is a block of documents (simple8b.py) with their ids, the number of the writing
task and where the block starts among that task's ids. Tasks hold ranges of document ids in order, so a
document's place among all ids is its task's, the block's and its own, added up; only one number for
each writing task is ever brought together.

Results for odd rows: a null text counts as empty and has the end id alone; null document ids come first;
rows with equal ids stand next to each other, in the order of their text's hash, and equal rows each have a result; a document is never
split, however long; no rows give files without blocks and no rows; columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simple8b
from .common import new_folder, workers_can_import
from .pieces import PieceTable
from .token_counts import TOKENIZER, Library, check_byte_level

#: A block ends when it has as many ids or documents.
BLOCK_IDS, BLOCK_DOCS = 1 << 18, 4096
END = 0
#: Texts encoded at once.
ROWS = 256

_encoders: dict[str, PieceTable] = {}


def _encoder(path: str) -> PieceTable:
    if path not in _encoders:
        library = Library(path)
        _encoders[path] = PieceTable(library, library.matches)
    return _encoders[path]


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Encodes each whole text, appends the end id and writes the files to a folder that must not exist."""
    workers_can_import(docs.sparkSession)
    path = path or public_tokenizers.path(TOKENIZER)
    check_byte_level(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = _encoder(path), TaskContext.get().partitionId()
        keys, found, held, number, before, id_type = [], [], 0, 0, 0, None

        def out() -> pa.RecordBatch:
            block = simple8b.write_block(np.concatenate(found), np.array([len(x) for x in found], np.uint32))
            arrays = [pa.array([task], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(id_type)), pa.array([block], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["task", "number", "before", "n_ids", "keys", "block"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, counts = enc(part.column(1))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end).astype(np.uint32, copy=False)
                ends += np.arange(1, len(ends) + 1)
                for key, a, b in zip(part.column(0).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    if found and (held + b - a > BLOCK_IDS or len(found) == BLOCK_DOCS):
                        yield out()
                        keys, found, held, number, before = [], [], 0, number + 1, before + held
                    keys.append(key)
                    found.append(ids[a:b])
                    held += b - a
        if found:
            yield out()

    source = docs.select(F.col(f"`{id_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    ranges = source.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("keys", T.ArrayType(source.schema[0].dataType)), T.StructField("block", T.BinaryType())])
    ranges.mapInArrow(run, schema).write.option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, ids_le: the ids of each document as little-endian unsigned 32-bit integers, with the end id."""
    workers_can_import(spark)
    files = spark.read.parquet(folder)
    key = T.StructField(id_col, files.schema["keys"].dataType.elementType)
    per_task = files.groupBy("task").agg(F.sum("n_ids").alias("n"))
    # one row for each task that wrote, so few that one task can add them up and all may have them
    bases = per_task.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, block, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, lengths = simple8b.read_block(block)
                raw, ends = ids.astype("<u4"), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                for at in range(0, len(keys), 512):
                    pairs = list(zip(ends[at : at + 512], ends[at + 1 : at + 513], strict=False))
                    arrays = [pa.array(keys[at : at + 512], batch.schema.field(0).type.value_type), pa.array(start + ends[at : at + len(pairs)]), pa.array([raw[a:b].tobytes() for a, b in pairs], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "ids_le"])

    blocks = files.join(F.broadcast(bases), "task").select("keys", "block", (F.col("base") + F.col("before")).alias("start"))
    return blocks.mapInArrow(run, T.StructType([key, T.StructField("start", T.LongType()), T.StructField("ids_le", T.BinaryType())]))


def written_and_read(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    folder = new_folder(docs.sparkSession, "token-files")
    write(docs, folder)
    return read(docs.sparkSession, folder).select("doc_id", "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32"))
