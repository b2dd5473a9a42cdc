"""From raw documents to token ids: quality, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return
the columns of documents, whatever other ones docs has.

1. quality classifier: rows predicted as bad go. Labels are those of sf_dir; rows held out teach nothing.
2. near duplicates: one document of each class stays, the one with the least doc_id.
3. mixing: rows are drawn to the target weights, some twice, some not at all, in shuffled order.
4. byte-level BPE: ids of each drawn document, and the digest of what they decode to.

Results for odd rows: null and empty texts have the score of the learned labels' share of good, which keeps them; are never duplicates of
each other; are drawn as often as their neighbours; and have no ids. Very long texts pass all stages whole. Of rows that are equal in id and text
one stays. Null ids are no id: their rows are told apart by text. Ties are broken by ids and hashes, so reruns agree. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertide.llm import bpe, mixing, order_minhash, quality
from papertide.llm.common import cut, table


def _columns_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select([F.col(f"`{c}`") for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    names = ("__quality_score", "__quality_predicted")
    return _columns_of(docs, quality.score(docs, model, names=names).where(f"{names[1]} = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns_of(docs, order_minhash.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns_of(docs, mixing.draws(mixing.mix(docs)))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(docs, decoded=True)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("mixing sources", mix_sources),
    ("byte-level BPE", to_token_ids),
]
#: No stage before the last can be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
