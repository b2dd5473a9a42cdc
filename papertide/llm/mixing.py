"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Each source's documents lie in the buckets of a seeded hash. A deck holds a source's words as often as its target needs;
each pass through the source lays its buckets in another seeded permutation, and within a bucket its documents by hash. The deck is cut
into blocks of equally many words, and the target is a quota of blocks from its top. The tree halves the output shards: of a node's quotas, one for each
source, the left half draws a multivariate-hypergeometric vector, the right half keeps the rest. So each
shard has an exact quota of every source, as if the blocks had been dealt like cards, and draws so many of the permuted
blocks, disjoint from all other shards'. What is taken of a document is the sum of what the shards drew of it. A shard is shuffled locally.

A document lies behind the words of all buckets before its own in the pass and of its bucket's
documents before it: windows hold no more than one bucket of one source, or one row for each bucket of a source, so a source may
hold most of the rows. The driver sees one total for each source and no more than SOURCES of them; with very many sources the blocks
of each are fewer, so that all together stay countable.

Results for odd rows: a null or empty text has size 0 and nothing is taken of it; a null source is a source
of its own, the last; repeated rows, and rows whose hashes tie, are taken each on their own; a very long text is one document whose words
blocks may share; a source without words has target 0; no rows give no rows;
columns of the input are kept as they are, whatever their names, as results have names of their own (RESULTS).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the query: weights by source in order, repeating; share of all words; most passes over a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
SOURCES = 1_000_000
#: Blocks of a pass through a source, and of all sources together at most.
BLOCKS, ALL_BLOCKS = 4096, 400_000_000
BUCKET_BITS, OUTPUTS, SEED = 12, 64, 20_240
#: Columns that mix() and draws() add.
RESULTS = ("__mix_size", "__mix_source_size", "__mix_target", "__mix_spans", "__mix_taken", "__mix_copy", "__mix_words", "__mix_output")


def targets(totals: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: by weight, none above `most` times its size, the excess reshared."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = share * sum(totals.values()), set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * totals[s]}
        if not full:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: most * totals[s] for s in full}
        left, free = left - sum(most * totals[s] for s in full), free - full
    return out


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source for each shard: shards x sources, whose columns add up to the quotas."""
    rng = np.random.default_rng(seed)

    def node(quota: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [quota]
        half = n // 2
        left = rng.multivariate_hypergeometric(quota, int(quota.sum()) * half // n, method="marginals")
        return node(left, half) + node(quota - left, n - half)

    return np.array(node(np.asarray(quotas, np.int64), shards))


def _source_key(source_col: str):
    """Not null, and different for null and empty."""
    source = F.col(f"`{source_col}`").cast("string")
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source))


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__mix_size": size, "__mix_source": _source_key(source_col), "__mix_hash": hashed, "__mix_bucket": F.shiftrightunsigned(hashed, 64 - BUCKET_BITS)})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = OUTPUTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The rows (or of them the columns to keep, which are then written once, so that texts are read once) with __mix_size, __mix_source_size, __mix_target, __mix_spans (output, copy, words: what each output shard's blocks hold of each copy), __mix_taken (their sum) and what draws() needs."""
    keyed = _keyed(docs, seed, id_col, text_col, source_col)
    if keep is not None:
        keyed = cut(keyed.select(*[F.col(f"`{c}`") for c in keep], "__mix_size", "__mix_source", "__mix_hash", "__mix_bucket"))
    per_bucket = cut(keyed.groupBy("__mix_source", "__mix_bucket").agg(F.sum("__mix_size").alias("words")))
    rows = per_bucket.groupBy("__mix_source").agg(F.sum("words")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    totals = {r[0][1:] if r[0][0] == "+" else None: r[1] for r in rows}
    target = targets(totals, weights, share, most)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    blocks = min(BLOCKS, max(1, int(ALL_BLOCKS / max(1, len(names)) / most)))
    block = [max(1, totals[s] // blocks) for s in names]
    quotas = [min(round(target[s] / b), int(most * totals[s]) // b) for s, b in zip(names, block, strict=True)]
    per_shard = split(np.array(quotas, np.int64), shards, seed) if names else np.zeros((shards, 0), np.int64)
    ends = per_shard.cumsum(axis=0).T * np.array(block, np.int64)[:, None] if names else per_shard.T
    table = [("-" if s is None else "+" + s, totals[s], float(target[s]), e.tolist()) for s, e in zip(names, ends, strict=True)]
    per_source = docs.sparkSession.createDataFrame(table, "__mix_source string, __mix_source_size long, __mix_target double, __mix_ends array<long>")
    # each pass lays the buckets in another order
    passes = F.sequence(F.lit(0), F.lit(max(0, int(np.ceil(most)) - 1)))
    laid = per_bucket.withColumn("pass", F.explode(passes))
    before = W.partitionBy("__mix_source", "pass").orderBy(F.xxhash64(F.lit(seed), "__mix_source", "pass", "__mix_bucket"), "__mix_bucket")
    laid = laid.withColumn("base", F.sum("words").over(before) - F.col("words"))
    bases = laid.groupBy("__mix_source", "__mix_bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "base"))), lambda x: x["base"]).alias("__mix_bases"))
    inside = W.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_hash", f"`{id_col}`").rowsBetween(W.unboundedPreceding, 0)
    placed = keyed.withColumn("__mix_at", F.sum("__mix_size").over(inside) - F.col("__mix_size")).join(bases, ["__mix_source", "__mix_bucket"])
    placed = placed.join(F.broadcast(per_source) if len(table) <= 10_000 else per_source, "__mix_source")

    def in_shards(base, copy):
        """The words that each shard's blocks hold of one copy of the document."""
        first = copy * F.col("__mix_source_size") + base + F.col("__mix_at")
        end_before = lambda j: F.when(j > 0, F.get("__mix_ends", j - 1)).otherwise(0)
        words = lambda end, j: F.greatest(F.lit(0), F.least(first + F.col("__mix_size"), end) - F.greatest(first, end_before(j)))
        return F.transform("__mix_ends", lambda end, j: F.struct(j.alias("output"), copy.alias("copy"), words(end, j).alias("words")))

    spans = F.filter(F.flatten(F.transform("__mix_bases", in_shards)), lambda x: x["words"] > 0)
    placed = placed.withColumn("__mix_spans", spans)
    return placed.withColumn("__mix_taken", F.aggregate("__mix_spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]))


def draws(mixed: DataFrame, whole: bool = True) -> DataFrame:
    """A row for each time that a document is drawn, with __mix_words of it, __mix_copy and its __mix_output shard, in each shard's shuffled order.

    whole: a copy that blocks of several shards share goes to the first of them; the one document of a source that the
    target cuts in a pass is drawn whole if half of it or more is, else not at all; and a document without words is drawn as often
    as its neighbours (once if all its source has none).
    """
    size, source_size = F.col("__mix_size"), F.col("__mix_source_size")
    if whole:
        # of each copy the words in all shards, and the first shard
        of = lambda c: F.filter("__mix_spans", lambda x: x["copy"] == c)
        copies = F.array_distinct(F.transform("__mix_spans", lambda x: x["copy"]))
        per_copy = F.transform(copies, lambda c: F.struct(c.alias("copy"), F.aggregate(of(c), F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("words"), F.array_min(F.transform(of(c), lambda x: x["output"])).alias("output")))
        kept = F.filter(per_copy, lambda x: x["words"] * 2 >= size)
        top = F.element_at("__mix_ends", -1)
        reached = F.transform("__mix_bases", lambda base, c: F.struct(c.alias("copy"), F.lit(0).cast("long").alias("words"), F.when(c * source_size + base + F.col("__mix_at") < top, F.lit(0)).alias("output")))
        once = F.array(F.struct(F.lit(0).alias("copy"), F.lit(0).cast("long").alias("words"), F.lit(0).alias("output")))
        found = F.when(size > 0, kept).when(source_size == 0, once).otherwise(F.filter(reached, lambda x: x["output"].isNotNull()))
    else:
        found = F.col("__mix_spans")
    drawn = mixed.withColumn("__mix_d", F.explode(found))
    out = drawn.withColumns({"__mix_copy": F.col("__mix_d.copy"), "__mix_words": F.when(F.lit(whole), size).otherwise(F.col("__mix_d.words")), "__mix_output": F.col("__mix_d.output")})
    out = out.withColumn("__mix_order", F.xxhash64(F.col("__mix_hash"), F.col("__mix_copy"))).repartition(F.col("__mix_output")).sortWithinPartitions("__mix_output", "__mix_order")
    return out.drop("__mix_d", "__mix_source", "__mix_bucket", "__mix_bases", "__mix_ends", "__mix_hash", "__mix_at", "__mix_order", "__mix_spans")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and what each output shard takes of it."""
    found = mix(docs, keep=["doc_id"])
    return found.select("doc_id", *[F.col(f"__mix_{c}").alias(c) for c in ("size", "source_size", "target", "taken")], F.col("__mix_spans").alias("shards"))
