"""Sentences of texts that are nearly those of given items, by words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, udfs

#: Similarity from which sentences are nearly the same: twice the words that match in order, by all words of both.
LEAST = 0.68
#: Distinct sentences of items that are sent to all tasks; more of them are joined.
MOST = 50_000
#: Distinct sentences of texts, of SHORT characters at most, whose findings a task keeps at hand, as some are said again and again.
KEPT, SHORT = 1 << 17, 200


def _sentences(x: Column) -> Column:
    return F.transform(text.plain_sentences(x), text.key)


class Index:
    """Given sentences by their rarest words.

    Twice the common words by all words bounds the similarity, so for each length of the other sentence there are words that both must hold, and
    one at least is among the rarest ones but so many. What words are rare is read from the given sentences, so few of them are met by a word.
    """

    def __init__(self, wanted: list[str], low: float) -> None:
        self.low, self.wanted = low, wanted
        self.words = [b.split() for b in wanted]
        self.counts = [Counter(y) for y in self.words]
        often = Counter(w for c in self.counts for w in c)
        self.places: dict[str, list[tuple[int, int, int]]] = {}
        share = low / (2 - low)
        for k, y in enumerate(self.words):
            ranked = sorted(y, key=lambda w: (often[w], w))
            seen: set[str] = set()
            for place, w in enumerate(ranked[: len(y) - ceil(len(y) * share - 1e-9) + 1]):
                if w not in seen:
                    seen.add(w)
                    self.places.setdefault(w, []).append((k, len(y), place))
        self.kept: dict[str, list[tuple[int, float]]] = {}

    def _needed(self, n: int, m: int) -> int:
        """Words that two sentences of n and m words have in common at least."""
        return max(1, ceil((n + m) * (self.low / 2) - 1e-9))

    def near(self, s: str) -> list[tuple[int, float]]:
        """The given sentences that are nearly this one, by number, and how similar they are."""
        if (found := self.kept.get(s)) is None:
            found = self._near(s)
            if len(s) <= SHORT:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[s] = found
        return found

    def _near(self, s: str) -> list[tuple[int, float]]:
        x = s.split()
        n, mine = len(x), None
        last: dict[int, int] = {}  # the last place at which a word must be met, by length
        met: set[int] = set()
        for w in set(x):
            for k, m, place in self.places.get(w, ()):
                if (most := last.get(m)) is None:
                    need = self._needed(n, m)
                    most = last[m] = m - need if need <= n else -1
                if place <= most:
                    met.add(k)
        out = []
        for k in met:
            mine = mine or Counter(x)
            y = self.words[k]
            if sum(min(c, mine[w]) for w, c in self.counts[k].items() if w in mine) >= self._needed(n, len(y)):
                ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
                if ratio >= self.low:
                    out.append((k, ratio))
        return out


def _indexed(docs: DataFrame, wanted: list[str], low: float) -> DataFrame:
    """id, b, similarity of docs(id, sentences): the given sentences that any of a row's are near to. Texts are not exchanged."""
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given.value, low)
        for batch in batches:
            rows, bs, ratios = [], [], []
            for at in range(batch.num_rows):
                best: dict[int, float] = {}
                for s in dict.fromkeys(batch.column(1)[at].as_py() or ()):
                    for k, ratio in index.near(s):
                        best[k] = max(ratio, best.get(k, 0.0))
                rows += [at] * len(best)
                bs += [index.wanted[k] for k in best]
                ratios += best.values()
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(bs, pa.string()), pa.array(ratios, pa.float64())], names=["id", "b", "similarity"])

    schema = T.StructType([docs.schema["id"], T.StructField("b", T.StringType()), T.StructField("similarity", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _joined(docs: DataFrame, wanted_of: DataFrame, low: float) -> DataFrame:
    """s, b, similarity of the distinct sentences of docs(s) and wanted_of(b): those that share one of the other's rarest words, are of lengths that allow it and share
    enough words are compared in full."""
    share = low / (2 - low)
    said = docs.select("s").distinct().withColumn("x", text.words(F.col("s")))
    wanted = wanted_of.select("b").distinct().withColumn("y", text.words(F.col("b")))
    met = wanted.select("b", "y", F.explode("y").alias("word"))
    # words that no item says lead nowhere
    held = said.select("s", F.size("x").alias("n"), F.explode(F.array_distinct("x")).alias("word")).join(met.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").agg(F.count("*").alias("often"))
    ranked = met.join(often, "word", "left").groupBy("b").agg(F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("r"))
    few = F.size("y") - F.ceil(F.size("y") * share - 1e-9).cast("int") + 1
    # with one word more, two of them are shared, if the sentences share two words at all
    rare = ranked.select("b", F.size("y").alias("m"), F.posexplode(F.array_distinct(F.transform(F.slice("r", F.lit(1), few + 1), lambda r: r["word"]))).alias("place", "word"), F.size(F.array_distinct(F.transform(F.slice("r", F.lit(1), few), lambda r: r["word"]))).alias("first"), (F.size(F.array_distinct("y")) < F.size("y")).alias("repeats"))
    fits = (F.col("n") >= F.col("m") * share - 1e-9) & (F.col("m") >= F.col("n") * share - 1e-9)
    hits = held.join(rare, "word").where(fits).groupBy("s", "b").agg(F.count("*").alias("words"), F.min("place").alias("place"), F.first("first").alias("first"), F.first("m").alias("m"), F.first("repeats").alias("repeats"))
    # a word that is said twice counts as two, so such sentences need but one here
    two = F.col("repeats") | (F.ceil(F.col("m") * share - 1e-9) < 2) | (F.col("words") >= 2)
    pairs = hits.where(two & (F.col("place") < F.col("first"))).select("s", "b").withColumns({"x": text.words(F.col("s")), "y": text.words(F.col("b"))})
    enough = (F.size("x") + F.size("y")) * (low / 2) - 1e-9
    pairs = pairs.where(F.size(F.filter("y", lambda w: F.array_contains("x", w))) >= enough).where(F.size(F.filter("x", lambda w: F.array_contains("y", w))) >= enough)
    return pairs.select("s", "b", udfs.token_similarity("s", "b").alias("similarity")).where(F.col("similarity") >= low)


def near(documents: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """id, item_id, similarity: documents(id, text) and items(item_id, text) with sentences that are nearly the same, and the best similarity.

    Items of up to MOST distinct sentences are an index in each task, through which texts pass where they are read. More are met by exchanges of
    the words of both sides.
    """
    low = least - 5e-5  # what rounds to it
    docs = documents.select("id", _sentences(F.col("text")).alias("sentences"))
    wanted_of = items.select("item_id", F.explode(_sentences(F.col("text"))).alias("b")).where("b <> ''").distinct()
    wanted = [r[0] for r in wanted_of.select("b").distinct().limit(MOST + 1).collect()]
    if len(wanted) > MOST:
        said = docs.select("id", F.explode("sentences").alias("s")).where("s <> ''")
        alike = _joined(said, wanted_of, low).join(said, "s").select("id", "b", "similarity")
    else:
        alike = _indexed(docs, wanted, low)
    alike = alike.withColumn("similarity", F.round("similarity", 4)).where(F.col("similarity") >= least)
    return alike.join(wanted_of, "b").groupBy("id", "item_id").agg(F.max("similarity").alias("similarity"))
