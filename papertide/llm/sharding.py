"""Shards of near equal bytes by histogram sort. DataFrame operations only.

Rows are ordered by the hash of their text, then their id, then their place in the scan; so equal texts
stand together. Texts are read once: the keys, sizes and wanted columns are written to the shared folder, and all later steps read
those. Every round counts the exact bytes, on all partitions, below evenly spaced candidate keys
inside the intervals that still hold a wanted boundary, and keeps the interval with the crossing, until
each boundary is within tolerance or lies between two neighbouring rows. A group of equal texts that a
boundary would cut is kept whole when that stays within tolerance; a larger one is cut by id, as
no other cut can make the shards equal. Then the rows are exchanged once, by pieces of shards.

The driver gets, a round, at most PROBES counts (or LEAST_PROBES for each open interval, of which there are no more than
pieces); the number of pieces is bounded by PIECES for each shard, whatever the size of the input.

Results for odd rows: a null text has size 8 and the checksum of nothing, as the empty one has; null ids come first among equal
texts; repeated rows each have their own slot; a very long text is one row, however many bytes a shard is to have; with fewer rows than
shards some shards are empty; no rows give no rows; other columns are kept as they are, whatever their names, as results have names of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SHARDS = 24
#: Share of a shard's bytes by which a boundary may be off; for the boundaries of pieces within a shard, share of a piece.
TOLERANCE, PIECE_TOLERANCE = 0.001, 0.25
#: Cells of the first round; cells of all open intervals of a later one, and of one interval at least.
FIRST_PROBES, PROBES, LEAST_PROBES = 1024, 1 << 16, 8
#: Pieces of a shard at most, and the bytes that a piece is to have.
PIECES, PIECE_BYTES = 256, 256 << 20
_KEYS = ("__hs_hash", "__hs_id", "__hs_place")
#: Columns that shard() adds.
RESULTS = ("__hs_size", "__hs_crc32", "__hs_shard", "__hs_slot")
_LOWEST = -(1 << 63)


@dataclass
class _Open:
    """An interval of one level's key, below fixed keys of the levels before it; below: bytes under its lower end."""

    goals: list[int]
    fixed: tuple[int, ...]
    low: int
    high: int
    below: int
    size: int


def _keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        *[F.col(f"`{c}`") for c in keep],
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("__hs_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__hs_crc32"),
        F.xxhash64(text).alias("__hs_hash"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LOWEST)).alias("__hs_id"),
        F.monotonically_increasing_id().alias("__hs_place"),
    )


def _histogram(keyed: DataFrame, level: int, open_: list[_Open]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each interval its cells that hold rows: (cell, bytes, least key, greatest key), in order."""
    spark, key = keyed.sparkSession, F.col(_KEYS[level])
    probes = max(LEAST_PROBES, PROBES // len(open_))
    width = [max(1, -(-(x.high - x.low + 1) // probes)) for x in open_]
    if len(open_) == 1 and not open_[0].fixed and open_[0].low == _LOWEST:  # the first round: all rows, by the key's high bits
        rows = keyed.select(F.lit(0).alias("i"), F.shiftrightunsigned(key.bitwiseXOR(F.lit(_LOWEST)), 64 - FIRST_PROBES.bit_length() + 1).cast("long").alias("cell"), F.col("__hs_size").alias("size"), key.alias("k"))
    else:
        fixed = [f"f{i}" for i in range(level)]
        table = [(i, *x.fixed, x.low, x.high, w) for i, (x, w) in enumerate(zip(open_, width, strict=True))]
        intervals = spark.createDataFrame(table, "i int, " + "".join(f"{x} long, " for x in fixed) + "low long, high long, width long")
        on: Column = (key >= F.col("low")) & (key <= F.col("high"))
        if level:
            for x, k in zip(fixed, _KEYS, strict=False):
                on = (F.col(k) == F.col(x)) & on
            joined = keyed.join(F.broadcast(intervals), on)
        else:  # by the cell of the first round, in which each interval lies
            shift = 64 - FIRST_PROBES.bit_length() + 1
            of = lambda c: F.shiftrightunsigned(c.bitwiseXOR(F.lit(_LOWEST)), shift)
            joined = keyed.join(F.broadcast(intervals), (of(key) == of(F.col("low"))) & on)
        cell = F.floor((key.cast("decimal(20,0)") - F.col("low")) / F.col("width").cast("decimal(20,0)")).cast("long")
        rows = joined.select("i", cell.alias("cell"), F.col("__hs_size").alias("size"), key.alias("k"))
    out: dict[int, list] = {}
    for r in rows.groupBy("i", "cell").agg(F.sum("size"), F.min("k"), F.max("k")).collect():
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {i: sorted(x) for i, x in out.items()}


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[tuple[int, int, int]], int]:
    """Lower bounds of all pieces but the first, and the pieces of a shard."""
    start = [_Open([], (), _LOWEST, (1 << 63) - 1, 0, 0)]
    cells = _histogram(keyed, 0, start)
    total = sum(x[1] for x in cells.get(0, []))
    if not total:
        return [], 1
    pieces = max(1, min(PIECES, total // (shards * PIECE_BYTES)))
    n = shards * pieces
    goals = [total * k // n for k in range(n)]
    slack = [total / shards * tolerance if k % pieces == 0 else total / n * PIECE_TOLERANCE for k in range(n)]
    start[0].goals = list(range(1, n))
    found: dict[int, tuple[int, int, int]] = {}
    level, open_, waiting = 0, start, []
    while open_:
        narrower: list[_Open] = []
        for i, x in enumerate(open_):
            below, ends, rows = x.below, [], cells.get(i, [])
            for _, size, _, _ in rows:
                below += size
                ends.append(below)
            after = [r[2] for r in rows[1:]] + [None]  # the least key above each cell
            crossing: dict[int, list[int]] = {}
            for k in x.goals:
                c = bisect_left(ends, goals[k])
                low, high = ends[c] - rows[c][1], ends[c]
                near, key = min((goals[k] - low, rows[c][2]), (high - goals[k], after[c]), key=lambda y: y[0])
                last = level == len(_KEYS) - 1 and rows[c][2] == rows[c][3]
                if near <= slack[k] or last:
                    # beyond the interval's last cell: the next key of its level, or of the level above
                    found[k] = _bound(x, key, level)
                else:
                    crossing.setdefault(c, []).append(k)
            for c, ks in crossing.items():
                _, size, least, most = rows[c]
                base = ends[c] - size
                if least == most:  # one key: its rows are told apart by the next level's
                    waiting.append(_Open(ks, (*x.fixed, least), _LOWEST, (1 << 63) - 1, base, size))
                else:
                    narrower.append(_Open(ks, x.fixed, least, most, base, size))
        if not narrower and waiting:
            level, narrower, waiting = level + 1, waiting, []
            for x, (low, high) in zip(narrower, _ranges(keyed, level, narrower), strict=True):
                x.low, x.high = low, high
        open_ = narrower
        cells = _histogram(keyed, level, open_) if open_ else {}
    bounds = [found[k] for k in range(1, n)]
    return [max(bounds[: i + 1]) for i in range(len(bounds))], pieces


def _bound(x: _Open, key: int | None, level: int) -> tuple[int, int, int]:
    if key is None:  # above all of the interval
        key = x.high + 1
    while key > (1 << 63) - 1:  # no key above on this level
        level -= 1
        key = x.fixed[level] + 1
    return (*x.fixed[:level], key, *[_LOWEST] * (len(_KEYS) - 1 - level))


def _ranges(keyed: DataFrame, level: int, open_: list[_Open]) -> list[tuple[int, int]]:
    """The least and the greatest key of a level below each interval's fixed keys."""
    fixed = [f"f{i}" for i in range(level)]
    table = keyed.sparkSession.createDataFrame([(i, *x.fixed) for i, x in enumerate(open_)], "i int, " + ", ".join(f"{x} long" for x in fixed))
    on = F.lit(True)
    for x, k in zip(fixed, _KEYS, strict=False):
        on = on & (F.col(k) == F.col(x))
    got = {r[0]: (r[1], r[2]) for r in keyed.join(F.broadcast(table), on).groupBy("i").agg(F.min(_KEYS[level]), F.max(_KEYS[level])).collect()}
    return [got[i] for i in range(len(open_))]


def _piece(bounds: list[tuple[int, int, int]]) -> Column:
    """How many bounds lie at or below a row's key, by binary search in constant arrays."""
    if not bounds:
        return F.lit(0)
    step = 1 << (len(bounds).bit_length() - 1)
    filled = [*bounds, *[None] * (2 * step - len(bounds))]
    arrays = [F.array(*[F.lit(b[i] if b else None).cast("long") for b in filled]) for i in range(3)]
    at = F.lit(0)
    steps = F.array(*[F.lit(step >> i) for i in range(step.bit_length())])

    def forward(found: Column, s: Column) -> Column:
        probe = found + s
        b = [F.get(a, probe - 1) for a in arrays]
        k = [F.col(x) for x in _KEYS]
        reached = b[0].isNotNull() & ((b[0] < k[0]) | ((b[0] == k[0]) & ((b[1] < k[1]) | ((b[1] == k[1]) & (b[2] <= k[2])))))
        return F.when(reached, probe).otherwise(found)

    return F.aggregate(steps, at, forward)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of docs, or of them the columns to keep, with __hs_size, __hs_crc32, __hs_shard and __hs_slot, the place in the shard."""
    keep = docs.columns if keep is None else keep
    keyed = cut(_keyed(docs, id_col, text_col, keep))
    bounds, pieces = splitters(keyed, shards, tolerance)
    placed = keyed.withColumn("__hs_piece", _piece(bounds))
    # one row for each piece that holds rows: how many rows of its shard come before
    per_piece = placed.groupBy("__hs_piece").agg(F.count("*").alias("__hs_rows"))
    of_shard = F.expr(f"cast(__hs_piece div {pieces} as int)")
    before = W.partitionBy(of_shard).orderBy("__hs_piece")
    bases = per_piece.select("__hs_piece", (F.sum("__hs_rows").over(before) - F.col("__hs_rows")).alias("__hs_base"))
    inside = W.partitionBy("__hs_piece").orderBy(*_KEYS)
    ranked = placed.withColumn("__hs_row", F.row_number().over(inside) - 1)
    out = ranked.join(F.broadcast(bases), "__hs_piece")
    return out.select(*[F.col(f"`{c}`") for c in keep], "__hs_size", "__hs_crc32", of_shard.alias("__hs_shard"), (F.col("__hs_base") + F.col("__hs_row")).alias("__hs_slot"))


def by_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    found = shard(docs, keep=["doc_id"])
    names = {"size": "__hs_size", "text_crc32": "__hs_crc32", "shard": "__hs_shard", "slot": "__hs_slot"}
    return found.select("doc_id", *[F.col(c).alias(k) for k, c in names.items()], F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))
