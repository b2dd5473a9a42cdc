"""Features of the rows of one source within a time before each row, by a sweep with two pointers.

The time of a source is cut into slices as wide as the longest window. Each row goes to its own slice and to the next one, whose
windows reach back to it; so a slice has all that its windows need, a source of any size is as many groups as its
time has slices, and a window never spans more than two. Slices are exchanged as narrow rows, sorted by time, and streamed: a task
holds the rows of the longest window of one slice, not the slice. A sweep keeps, for each window, how often it holds
each language, the sum of lengths, and the lengths in a sorted array that bisection maintains and
that is indexed directly for both ranks. Rows of one time share their window, which ends before it.

At times that follow ids, as here, a source has some 4,320 rows in the longest window at most, whatever the table's size. Several rows of one time are
held once each while they are in a window. Nothing goes to the driver, and nothing is broadcast.

Results for odd rows: a null source is a source; a null text has no length, the empty one has length 0, both are events; a null language is not counted;
a null id, or one so large that its time exceeds 64 bits, has no time: it is in no window, and its own windows are empty, as are those of a
source's first row; repeated rows count each; rows of one time aren't in each other's windows; very long texts are one
length; no rows give no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_can_import

#: Widths of the windows in seconds, and the percentages of their two ranks.
WINDOWS, RANKS = (600, 43_200), (50, 90)
_FOUND = ("window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars")


class Window:
    """The rows of one source whose times are in [now - width, now)."""

    def __init__(self, width: int) -> None:
        self.width, self.head, self.tail = width, 0, 0
        self.sum, self.langs, self.lengths = 0, {}, []

    def move(self, past: list[tuple], now: int) -> None:
        """Both pointers forward to a time; past is in order of time."""
        low = now - self.width
        while self.tail < self.head and past[self.tail][0] < low:
            _, length, lang = past[self.tail]
            self.tail += 1
            if length is not None:
                self.sum -= length
                del self.lengths[bisect_left(self.lengths, length)]
            if lang is not None:
                self.langs[lang] -= 1
                if not self.langs[lang]:
                    del self.langs[lang]
        while self.head < len(past) and past[self.head][0] < now:
            at, length, lang = past[self.head]
            self.head += 1
            if at < low:  # left before it was met: then all before it have, too
                self.tail = self.head
                continue
            if length is not None:
                self.sum += length
                insort(self.lengths, length)
            if lang is not None:
                self.langs[lang] = self.langs.get(lang, 0) + 1

    def features(self, now: int | None) -> tuple:
        m = len(self.lengths)
        ranks = [self.lengths[-(-p * m // 100) - 1] if m else None for p in RANKS]
        return (self.width, now, self.head - self.tail, self.sum, len(self.langs), *ranks)


class Sweep:
    """The windows of one source's slice, moved along its rows in order of time."""

    def __init__(self, widths: tuple[int, ...]) -> None:
        self.past: list[tuple] = []
        self.windows = [Window(w) for w in widths]
        self.now: int | None = None
        self.found: list[tuple] = []

    def add(self, at: int, length: int | None, lang: str | None) -> None:
        self.past.append((at, length, lang))
        if len(self.past) > 4096 and (done := min(w.tail for w in self.windows)) * 2 > len(self.past):
            del self.past[:done]
            for w in self.windows:
                w.head, w.tail = w.head - done, w.tail - done

    def at(self, now: int) -> list[tuple]:
        if now != self.now:
            for w in self.windows:
                w.move(self.past, now)
            self.now, self.found = now, [w.features(now) for w in self.windows]
        return self.found


def features(rows: DataFrame, time: Column, length: Column, keep: list[str], windows: tuple[int, ...] = WINDOWS, source_col: str = "source", lang_col: str = "lang", partitions: int | None = None) -> DataFrame:
    """For each row and each window the columns to keep, window_s, event_s (its time) and the features of its source's rows before it."""
    workers_can_import(rows.sparkSession)
    width, n = max(windows), len(keep)
    named = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{source_col}`").alias("source"), time.cast("long").alias("at"), length.cast("long").alias("length"), F.col(f"`{lang_col}`").alias("lang"))
    own = F.expr(f"at div {width} - if(at % {width} < 0, 1, 0)")
    # rows without a time meet nothing, so any task will do
    slices = F.when(F.col("at").isNull(), F.array(F.struct(F.xxhash64(F.monotonically_increasing_id()).alias("slice"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own"))))
    dealt = named.withColumn("s", F.explode(slices)).select(*[f"k{i}" for i in range(n)], "source", "s.slice", "s.own", "at", "length", "lang")
    by = ["source", "slice"]
    dealt = (dealt.repartition(partitions, *by) if partitions else dealt.repartition(*by)).sortWithinPartitions(*by, "at")
    kinds = [named.schema[f"k{i}"].dataType for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [w.features(None) for w in Sweep(windows).windows]
        place, sweep = None, None
        for batch in batches:
            source, slice_, mine, at, lengths, langs = (c.to_pylist() for c in batch.columns[n:])
            rows_of, found = [], []
            for i, here in enumerate(zip(source, slice_, strict=True)):
                if at[i] is None:
                    rows_of.append(i)
                    found += none
                    continue
                if here != place:
                    place, sweep = here, Sweep(windows)
                if mine[i]:
                    rows_of.append(i)
                    found += sweep.at(at[i])
                sweep.add(at[i], lengths[i], langs[i])
            kept = batch.select(list(range(n))).take(pa.array([i for i in rows_of for _ in windows], pa.int64()))
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], names=[*[f"k{i}" for i in range(n)], *_FOUND])

    schema = T.StructType([T.StructField(f"k{i}", k) for i, k in enumerate(kinds)] + [T.StructField(c, T.LongType()) for c in _FOUND])
    return dealt.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *_FOUND)


def time_of(id_: Column) -> Column:
    """60 * floor((id + (h mod 10000)) / 6) with h the checksum of the id's digits; null where that exceeds 64 bits."""
    x = F.try_add(id_.cast("long"), F.crc32(id_.cast("long").cast("string").cast("binary")) % 10_000)
    return F.try_multiply(F.try_subtract(x, F.pmod(x, F.lit(6))), F.lit(10).cast("long"))


def before_each(docs: DataFrame, windows: tuple[int, ...] = WINDOWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """id_col, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars: a row for each document and window."""
    return features(docs, time_of(F.col(f"`{id_col}`")), F.length(F.col(f"`{text_col}`")), [id_col], windows, source_col, lang_col)


_STEP = "list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
#: The checksum bit by bit, in a table of its 256 steps.
SQL = f"""
WITH steps AS (SELECT list({_STEP} ORDER BY c) AS t FROM range(256) r(c)),
d AS (SELECT doc_id, source, lang, length(text) AS n, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM documents, steps),
e AS (SELECT *, 60 * floor((doc_id + h % 10000) / 6)::BIGINT AS event_s FROM d),
w AS (
  SELECT doc_id, 600 AS window_s, event_s, count(*) OVER w AS n_events, sum(n) OVER w AS s, count(DISTINCT lang) OVER w AS n_langs, list(n) FILTER (n IS NOT NULL) OVER w AS l
  FROM e WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 600 PRECEDING AND 1 PRECEDING)
  UNION ALL
  SELECT doc_id, 43200, event_s, count(*) OVER w, sum(n) OVER w, count(DISTINCT lang) OVER w, list(n) FILTER (n IS NOT NULL) OVER w
  FROM e WINDOW w AS (PARTITION BY source ORDER BY event_s RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING))
SELECT doc_id, window_s::BIGINT AS window_s, event_s, n_events, coalesce(s, 0)::BIGINT AS sum_chars, n_langs, list_sort(l)[(len(l) + 1) // 2] AS median_chars, list_sort(l)[(90 * len(l) + 99) // 100] AS high_chars FROM w
"""
