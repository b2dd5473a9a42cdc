"""What each of five filters removes, in every order in which they can be applied.

Words are a relation: texts are exchanged once by document, exploded into words, aggregated by (document, word) and then by document for totals
and distinct words, so that no word is exchanged. The other tests are columns of a narrow row for each document: capitals and symbols from the
text, copies from the least id of each text's digest, labels by id; they are joined to the totals by an outer join. A document is then one of 32 sets of filters
that it fails, and a part (source) is 32 conditional counts, as many of good and of toxic documents: aggregated
before the exchange, so a part of any size is a row for each task. Narrow rows and first ids are written to the shared folder; texts are read twice. All orders, and each filter's Shapley share, follow from those
counts: in a set of k failing filters each comes first in 1/k of the orders.

Letters: A has too few words, B repeats them, C shouts, D holds symbols, E is a copy of a document with a smaller id.

Results for odd rows: a null text is the empty one: it fails A alone, and E if a smaller id has no text either; a very long text's words are many
rows; a null source is the part "", as an empty one is; repeated rows count each, and are no copies of each other as none has a smaller
id; a null id is neither smaller nor greater, and has no labels; of several labels of an id one with quality 1 or toxic 1 is enough; no rows give no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: Thresholds of A (words), B (distinct words of 100) and C (capitals of 100 characters), and the symbols of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"


def word_totals(docs: DataFrame) -> DataFrame:
    """docs(id, hash, text): id, hash, n_words, n_distinct of each text, once for rows that are equal."""
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    # each row has the empty word once, which counts the rows of a text and keeps texts without words
    of = F.when(trimmed == "", F.array(F.lit(""))).otherwise(F.split(F.concat(F.lit(" "), trimmed), _SPACE))
    words = docs.repartition("id", "hash").select("id", "hash", F.explode(of).alias("word"))
    counted = words.groupBy("id", "hash", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    totals = counted.groupBy("id", "hash").agg(F.sum(F.when(real, F.col("n"))).alias("n"), F.count_if(real).alias("n_distinct"), F.sum(F.when(~real, F.col("n"))).alias("rows"))
    return totals.select("id", "hash", F.coalesce(F.expr("n div rows"), F.lit(0)).alias("n_words"), "n_distinct")


def failing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, rows, mask (bit i: fails the i-th filter), good, toxic: a row for each id, text and part."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    tested = named.select("id", "part", "hash", F.unhex(F.sha2("text", 256)).alias("digest"), (capitals * 100 > F.length("text") * MOST_CAPITALS).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    flags = cut(tested.groupBy("id", "part", "hash", "digest", "c", "d").agg(F.count("*").alias("rows")))
    # written, so that the join below is between two exchanges, of which Spark splits a text's rows if it has very many
    first = cut(flags.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    of_id = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    f, w = flags.alias("f"), word_totals(named.select("id", "hash", "text")).alias("w")
    df = f.join(w, F.col("f.id").eqNullSafe(F.col("w.id")) & (F.col("f.hash") == F.col("w.hash")), "left").select("f.*", "w.n_words", "w.n_distinct")
    df = df.join(first, "digest", "left").join(of_id, df["id"] == of_id["doc_id"], "left")
    fails = [F.col("n_words") < LEAST_WORDS, F.col("n_distinct") * 100 < F.col("n_words") * LEAST_DISTINCT, F.col("c"), F.col("d"), F.coalesce(F.col("id") > F.col("first"), F.lit(False))]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return df.select("id", "part", "rows", mask.alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def set_counts(found: DataFrame) -> DataFrame:
    """part, n, good, toxic: arrays of SETS counts, by the set of filters that documents fail."""
    kinds = {"n": "true", "good": "good", "toxic": "toxic"}
    counts = [F.expr(f"sum(if(mask = {m} and {x}, rows, 0)) as {k}{m}") for k, x in kinds.items() for m in range(SETS)]
    return found.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{k}{m}" for m in range(SETS)]).alias(k) for k in kinds])


def _over(counts: str, weight) -> Column:
    """The sum of weight(set) * count over all sets."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda total, m: total + weight(m).cast("long") * F.get(F.col(counts), m))


def all_orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    bit_of = lambda letter: F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(FILTERS) for x in (c, 1 << i)]), letter)
    df = counts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.transform(F.filter(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: i < F.col("step")), lambda i: bit_of(F.substring("filter_order", i, F.lit(1))))
    df = df.withColumns({"bit": bit_of(F.substring("filter_order", F.col("step"), F.lit(1))), "earlier": F.aggregate(before, F.lit(0), lambda a, b: a + b)})
    has = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    here = lambda m: has(m) & ~gone(m)
    return df.select(
        "part", "filter_order", "step",
        _over("n", lambda m: ~has(m) & ~gone(m)).alias("kept"),
        _over("n", here).alias("removed"),
        _over("n", lambda m: has(m) & gone(m)).alias("redundant"),
        F.get("n", "bit").alias("unique_fails"),
        _over("good", here).alias("good_lost"),
        _over("toxic", here).alias("toxic_lost"),
        _over("n", lambda m: F.when(has(m), F.lit(len(orders)) / F.bit_count(m)).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return all_orders(set_counts(failing(docs, labels, id_col, text_col, part_col)))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
first AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
d AS (SELECT part, w.doc_id,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic
  FROM w JOIN first USING (text)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, f.bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE instr(filter_order, g.letter) < step) AS earlier FROM o, range(1, 6) r(step), f WHERE f.letter = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step, s.bit,
    sum(n) FILTER (mask & bit = 0 AND mask & earlier::BIGINT = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & earlier::BIGINT = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & earlier::BIGINT <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & earlier::BIGINT = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & earlier::BIGINT = 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
