"""Near duplicates by Order MinHash, verified by banded alignment of words.

Words: lower-case, without punctuation at their ends. A document's k-mers are its shingles of five words,
each with the number of its occurrence. A sketch takes the LENGTH k-mers of least hash and keeps them
in the order of the text, so that it agrees for texts of small edit distance, not just of common content. Texts
with an equal sketch share a bucket. Of the texts that share a bucket
all are compared that aren't yet in one class: first, round by round, with the one of their bucket that has most links,
as long as a tenth of these pairs are similar, so that groups of near copies are one class after few pairs; then
each with each of another class. Only pairs that lengths or words exclude for certain are left out, so the
classes are those of a comparison of all pairs that share a bucket. Texts in buckets of more than MANY
are joined by their rarest words instead: of two similar texts with n words at most, 0.8 n words are common, so one at least
of the 0.2 n + 1 rarest words of each is, too, whatever order rarity is read from. So texts that share a passage
and nothing else are not compared each with each. Words that are among the rarest of more than RARE texts join no rows: their texts say
much the same, and are compared in blocks inside tasks, which send on links only. Nor do words that no other text of a length nearby has among its rarest.

Similar: 1 - edit distance in words / words of the longer text >= 0.8, exactly, by a bit-parallel
alignment inside the band of diagonals that this allows. Texts with equal words are one class from the start, by 128 bits of each word and of all, so
copies cost nothing. Links make components; a class's id is its least doc_id.

Short texts have too few k-mers for sketches. Those of fewer than SHORT words meet by their rarest words instead, as above, whatever their edits; so do longer ones
as far as they can be similar to one of those. A word that is among the rarest of more than RARE of them stands for a bucket with a second one
only: of the 0.2 n + 2 rarest words similar texts share two at least. Texts of fewer than five words are similar if they are equal.

Recall: texts that share a fraction j of their k-mers meet in one sketch with probability near j ** LENGTH;
SKETCHES sketches of two find 0.99 of the pairs with j = 0.2, which is what scattered edits of a fifth of the words leave on average, and nearly
all with j = 0.3 or more. Two texts of SHORT words or more that have no five words in a row in common, as when every fifth word is another, don't meet. Pairs with
a shorter text all meet.

Results for odd rows: no rows give no rows; null, empty and punctuation-only texts have no words and are one class each row by
itself; very long texts are sketched and aligned whole, k-mers in chunks; repeated rows share a class; of rows that are equal in id and text
the operator's `kept` marks all, keep_one() keeps one; a null id is not equal to any other value; of several that could be kept the least
id is, null ids last, then the least hash of id and text; class_id names a class by an id, so where ids are null or
repeated two classes can have the same, and class_key, the class's least digest, tells them apart; other columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, release, workers_can_import
from .components import components
from .pieces import PieceTable

K, SIMILARITY = 5, 0.8
#: 64-bit integers in which a text's words are marked.
BITS = 8
#: Words below which texts meet by their rarest words, and at which they can't be similar to a shorter one any more.
SHORT = 40
SHORT_END = int(SHORT / SIMILARITY)
#: Sketches of a text, and the k-mers that each takes.
SKETCHES, LENGTH = 128, 2
#: Members of a bucket above which they are joined by their rarest words, and slots in which words are counted for that.
MANY, SLOTS = 48, 1 << 18
#: Partitions whose words one task counts.
FAN_IN = 16
#: Texts that have a word among their rarest ones above which they meet in blocks instead, and texts of a block.
RARE, BLOCK = 64, 512
#: Texts of a task that make a word worth counting for that, words counted at once, and places in which is marked what words texts of a length share, and parts in which tasks' tables are added up.
SEVERAL, AT_ONCE, PLACES, PARTS = 8, 1 << 20, 1 << 22, 64
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The bits of a word in an alignment, and their bytes.
WORD_BYTES = 5
_WORD = np.uint64((1 << 8 * WORD_BYTES) - 1)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: k-mers times sketches hashed at once, and where.
CELLS = 1 << 17
_CELLS = np.empty(CELLS, np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _word(piece: str) -> bytes:
    """128 bits of each word of a piece, as four ids."""
    word = piece[1:] if piece[:1].isspace() else piece
    found = [word] if word.isalnum() else (_EDGES.sub("", x) for x in piece.split())
    return b"".join([xxhash.xxh3_128_digest(x.encode())[::-1] for x in found if x])


class _Words(PieceTable):
    """Words of pieces; shorter chunks, so that more pieces are kept before the table starts anew."""

    CHUNK = 1 << 16

    def encode(self, piece: str) -> bytes:
        return _word(piece)


_words = _Words(None, most=1 << 19)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word of all texts, in two columns, and where each text's words end."""
    ids, counts = _words(pc.utf8_lower(texts.fill_null("")))
    return np.ascontiguousarray(ids).view(np.uint64).reshape(-1, 2), np.cumsum(counts // 4)


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of each text's words, 40 bits each, which is what alignments compare. A stop behind a letter ends a word, as white space does."""
    hashes, ends = _hashes(texts)
    return np.split(hashes[:, 0] & _WORD, ends[:-1])


def words(text: str) -> np.ndarray:
    return words_of(pa.array([text]))[0]


def kmers(w: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers, in order; a shorter text is one k-mer."""
    w = w.astype(np.uint64)
    n = max(1, len(w) - k + 1)
    h = w[:n] if len(w) >= k else np.array([int(x) for x in w[:1]], np.uint64)
    for j in range(1, min(k, len(w))):
        h = h * _M + w[j : j + n]
    values = np.sort(h)
    if (values[1:] == values[:-1]).any():
        h = h + _occurrences(h) * _MIX
    return _mixed(h)


_SEEDS = _mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * _M)
#: What a k-mer's hash is added to and multiplied by, for each sketch.
_ADD, _TIMES = (_SEEDS >> np.uint64(32)).astype(np.uint32), _SEEDS.astype(np.uint32) | np.uint32(1)


def sketches(w: np.ndarray) -> np.ndarray:
    """The bucket of each sketch: its k-mers in order and its number."""
    h = kmers(w)
    return _buckets(h, np.array([len(h)]))[0]


def _all_sketches(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """sketches() of texts of so many words each, K at least, one after the other; 512 texts at most."""
    ends = np.cumsum(counts)
    inside = np.ones(len(w), bool)
    inside[(ends[:, None] - np.arange(1, K)).ravel()] = False
    n = len(w) - K + 1
    h = w[:n]
    for j in range(1, K):
        h = h * _M + w[j : j + n]
    h, counts = h[inside[:n]], counts - K + 1
    ends = np.cumsum(counts)
    # k-mers of a text that may be equal, by most of their bits
    near = np.sort(np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(55) | h >> np.uint64(9))
    for t in np.unique(near[1:][near[1:] == near[:-1]] >> np.uint64(55)).astype(int).tolist():
        own = h[ends[t] - counts[t] : ends[t]]
        own += _occurrences(own) * _MIX
    return _buckets(_mixed(h), counts)


def _buckets(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The buckets of texts of so many k-mers each, one after the other."""
    short, starts = (h >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
    at, rows = np.empty((LENGTH, len(counts), SKETCHES), np.int64), np.arange(SKETCHES)
    for t, (start, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
        own, step = short[start : start + n], min(SKETCHES, max(1, CELLS // n))
        # new memory for each text costs more than the hashes themselves
        cells = _CELLS if step * n <= len(_CELLS) else np.empty(step * n, np.uint32)
        for a in range(0, SKETCHES, step):
            x = cells[: min(step, SKETCHES - a) * n].reshape(-1, n)
            np.multiply(np.add(own, _ADD[a : a + step, None], out=x), _TIMES[a : a + step, None], out=x)
            for k in range(LENGTH):
                x.argmin(axis=1, out=at[k, t, a : a + step])
                if k + 1 < LENGTH:
                    x[rows[: len(x)], at[k, t, a : a + step]] = 0xFFFFFFFF
    at += starts[:, None]
    at.sort(axis=0)
    key = np.full(at.shape[1:], LENGTH, np.uint64)
    for places in at:
        key = _mixed(key * _M + h[places])
    return _mixed(key ^ _SEEDS)


def _occurrences(w: np.ndarray) -> np.ndarray:
    """The number of each word's occurrence, from 0."""
    order = np.argsort(w, kind="stable")
    out = np.empty(len(w), np.uint64)
    out[order] = _among_sorted(w[order])
    return out


def _among_sorted(x: np.ndarray) -> np.ndarray:
    """The number of each value's occurrence in a sorted array, from 0."""
    at = np.arange(len(x))
    starts = at.copy()
    starts[1:][x[1:] == x[:-1]] = 0
    return (at - np.maximum.accumulate(starts)).astype(np.uint64)


def _tokens(w: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return _mixed(w * _M + occurrence * _MIX)


def _slots(w: np.ndarray) -> np.ndarray:
    return ((w.astype(np.uint64) * _M) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def rarest(w: np.ndarray, often: np.ndarray, least: float = SIMILARITY, shared: int = 1, met: np.ndarray | None = None) -> np.ndarray:
    """Of a text's words, each with the number of its occurrence, the rarest ones, of which similar texts share one at least, or as many as are to be shared.

    met: which slots hold words of several texts; of the rarest words those of no other text are then left out, as they lead nowhere.
    """
    occurrence, slot = _occurrences(w), _slots(w)
    token = _tokens(w, occurrence)
    rank = often[slot] // (occurrence.astype(np.int64) + 1)
    at = np.lexsort((token, rank))[: int(len(w) * (1 - least) + 1e-9) + shared]
    return token[at if met is None else at[met[slot[at]]]]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences, or most + 1 if it is greater: columns of a band of 2 * most + 1 diagonals as bits of integers."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    skip = int(differs[0]) if len(differs) else n
    a, b, n = a[skip:], b[skip:], n - skip
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    skip = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - skip].tolist(), b[: len(b) - skip].tolist()
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return max(len(a), len(b))
    m, width = len(a), 2 * most + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full, low = (1 << width) - 1, most + 1
    # bit r of column j is row j - most + r; before the first column all differences below row 0 are 1
    up, down = full & ~((1 << most) - 1), 0
    score = min(most, m)
    for j, x in enumerate(b, 1):
        found, at = where.get(x, 0), j - low
        match = (found >> at if at > 0 else found << -at) & full
        diagonal = (((match & up) + up) ^ up) | match | down
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if j + most <= m:
            score += 1 - ((diagonal >> (width - 1)) & 1)
        else:
            r = m - j + most
            score += ((plus >> r) & 1) - ((minus >> r) & 1)
        if score - (len(b) - j) > most:
            return most + 1
        shifted = (diagonal & full) >> 1
        up = (minus | (full & ~(shifted | plus))) & full
        down = shifted & plus
    return min(score, most + 1)


def _at_most(a: np.ndarray, b: np.ndarray, here: np.ndarray, there: np.ndarray) -> int:
    """An upper bound of the edit distance: words at these places, which both hold once, are aligned as far as they rise, and what lies between is replaced."""
    order = np.argsort(here)
    here, there = here[order], there[order]
    if (there[1:] < there[:-1]).any():  # a longest rising chain
        ends: list[int] = []
        last: list[int] = []
        before = [-1] * len(there)
        for i, x in enumerate(there.tolist()):
            k = bisect_left(ends, x)
            ends[k : k + 1], last[k : k + 1] = [x], [i]
            before[i] = last[k - 1] if k else -1
        chain, i = [], last[-1]
        while i >= 0:
            chain.append(i)
            i = before[i]
        here, there = here[chain[::-1]], there[chain[::-1]]
    starts_a, starts_b = (np.concatenate([[0], x + 1]) for x in (here, there))
    gaps_a, gaps_b = np.append(here, len(a)) - starts_a, np.append(there, len(b)) - starts_b
    between = np.maximum(gaps_a, gaps_b)
    # equal words in gaps of equal length are no edits
    cost = int(between.sum())
    same = np.flatnonzero((gaps_a == gaps_b) & (between > 0))
    n = between[same]
    if len(n):
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        cost -= int((a[np.repeat(starts_a[same], n) + inside] == b[np.repeat(starts_b[same], n) + inside]).sum())
    return cost


def _threes(w: np.ndarray) -> np.ndarray:
    x = w.astype(np.uint64)
    return (x[:-2] * _M + x[1:-1]) * _M + x[2:]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sequences have in common, each of which holds a value once."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges two runs
    return int((both[1:] == both[:-1]).sum())


class _Ready:
    """A text's words in the order of their values, with their places, and each with the number of its occurrence."""

    def __init__(self, w: np.ndarray, bits: int = 8 * (8 - WORD_BYTES)):
        low = np.uint64((1 << bits) - 1)
        keys = (w.astype(np.uint64) << np.uint64(bits)) | np.arange(len(w), dtype=np.uint64)
        keys.sort()
        self.w, self.values, self.places = w, keys >> np.uint64(bits), (keys & low).astype(np.int64)
        self.tokens = (keys & ~low) | _among_sorted(self.values)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Words that the text holds once, and their places."""
        other = self.values[1:] != self.values[:-1]
        alone = np.append(other, True) & np.insert(other, 0, True)
        return self.values[alone], self.places[alone]


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit distance is small enough, exactly: by words that exclude it, else by an alignment at the words that both texts hold once, else by whole banded ones."""
    bits = 8 * (8 - WORD_BYTES)
    if max(len(a), len(b)) >= 1 << bits or any(len(w) and int(w.max()) >> (64 - bits) for w in (a, b)):  # numbers for words that leave no room for their places
        numbers = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.uint64)
        a, b, bits = numbers[: len(a)], numbers[len(a) :], 32
    return _similar(_Ready(a, bits), _Ready(b, bits), least)


def _similar(x: _Ready, y: _Ready, least: float) -> bool:
    a, b = x.w, y.w
    longest = max(len(a), len(b))
    most = int(longest * (1 - least) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) == len(b) and np.count_nonzero(a != b) <= most:
        return True
    # each edit changes one word at most: fewer common words than this exclude it
    if _common(x.tokens, y.tokens) < longest - most:
        return False
    (words_a, places_a), (words_b, places_b) = x.once(), y.once()
    if len(words_a) and len(words_b):
        at = np.minimum(np.searchsorted(words_b, words_a), len(words_b) - 1)
        both = words_b[at] == words_a
        if both.any() and _at_most(a, b, places_a[both], places_b[at[both]]) <= most:
            return True
    # and no more than three runs of three words, which tells texts apart that say the same words in another order
    if min(len(a), len(b)) > 2 and _common(*(np.sort(_mixed(v * _M + _among_sorted(v) * _MIX)) for v in (np.sort(_threes(a)), np.sort(_threes(b))))) < longest - 2 - 3 * most:
        return False
    band = 32
    while band < most:  # near copies need a narrow band only
        if edit_distance(a, b, band) <= band:
            return True
        band *= 8
    return edit_distance(a, b, most) <= most


def marks(w: np.ndarray) -> np.ndarray:
    """BITS integers with a bit for each word and number of its occurrence: an edit changes one at most, so similar texts differ by few bits."""
    return _all_marks(w, np.array([len(w)]))[0]


def _all_marks(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """marks() of texts of so many words each, one after the other."""
    bits = np.zeros((len(counts), 64 * BITS), bool)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort(text << np.uint64(8 * WORD_BYTES) | w)
    bits[text, _tokens(keys & _WORD, _among_sorted(keys)) & np.uint64(64 * BITS - 1)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _row(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text; null is not equal to any value."""
    named = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(named[0], F.lit("\n"), named[1]).cast("binary")))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 512):
            hashes, at = _hashes(part.column(2))
            sizes = np.diff(at, prepend=0)
            all_words, long = hashes[:, 0] & _WORD, sizes >= SHORT
            # texts without words are alone
            digests = [xxhash.xxh3_128_digest(both) if len(both) else b"-" + row for row, both in zip(part.column(0).to_pylist(), np.split(hashes, at[:-1]), strict=True)]
            kept = [packed(w) if len(w) >= K else None for w in np.split(all_words, at[:-1])]
            keys = _all_sketches(all_words[np.repeat(long, sizes)], sizes[long]) if long.any() else np.zeros(0, np.uint64)
            ends = np.cumsum(np.concatenate([[0], np.where(long, SKETCHES, 0)])).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            marked = pa.ListArray.from_arrays(pa.array(np.arange(0, BITS * len(sizes) + 1, BITS, dtype=np.int32)), pa.array(_all_marks(all_words, sizes).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), marked, flat, pa.array(kept, pa.binary())], names=["row", "id", "digest", "size", "bits", "keys", "words"])
        give_back()

    source = docs.select(_row(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("row", T.BinaryType()), T.StructField("id", source.schema["id"].dataType), T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])
    return source.mapInArrow(run, schema)


def _marked(numbers: DataFrame) -> DataFrame:
    """Which n there are, as bits: n counts the rows of a partition, so that a partition's lie in few rows of 4 KB, which can be sent to all executors however many they are."""
    bucket = F.bitmap_bucket_number("n")
    # brought together first, so that not each task has each bucket
    return cut(numbers.select("n", bucket.alias("bucket")).repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("of_bucket")))


def _having(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows whose n is marked."""
    at = F.bitmap_bit_position("n")
    byte = F.conv(F.hex(F.substring("of_bucket", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("bucket", F.bitmap_bucket_number("n")).join(F.broadcast(marked), "bucket")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(rows.columns)


def packed(w: np.ndarray) -> bytes:
    return zstandard.compress(w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes(), 1)


def _opened(x: pa.Scalar) -> np.ndarray:
    found = np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(-1, WORD_BYTES)
    out = np.zeros((len(found), 8), np.uint8)
    out[:, :WORD_BYTES] = found
    return out.view("<u8").ravel()


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs with whether they are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready = None, None
        for part in _slices(batches, 256):
            found = []
            for b, x, y in zip(part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                if b != last:  # a text's pairs mostly come one after the other
                    last, ready = b, _Ready(_opened(y))
                found.append(_similar(_Ready(_opened(x)), ready, least))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.bool_())], names=["a", "b", "similar"])
        give_back()

    # each side's texts alone are exchanged for it
    x, y = (_having(texts, _marked(pairs.select(F.col(c).alias("n")))) for c in "ab")
    both = pairs.join(x.select(F.col("n").alias("a"), F.col("words").alias("x")), "a").join(y.select(F.col("n").alias("b"), F.col("words").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similar boolean")


def _counts(w: np.ndarray) -> np.ndarray:
    """How many of a text's words fall in each of 512 cells, up to 255: an edit moves one at most."""
    return np.minimum(np.bincount((w.astype(np.uint64) * _M >> np.uint64(55)).astype(np.int64), minlength=512), 255).astype(np.uint8)


def _similar_in_blocks(texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join texts(n, component, size, words) of different components as all similar pairs do: pairs whose lengths allow it are compared inside tasks, each of which holds two blocks at most and sends a link less than it has texts at most."""
    step = float(-np.log(least))
    texts = texts.withColumn("level", F.floor(F.log("size") / step).cast("int"))  # similar texts are of one level or of two neighbours
    per_level = {r[0]: r[1] for r in texts.groupBy("level").count().collect()}  # as many as a length has such steps
    blocks = F.create_map(*[F.lit(x) for level, n in per_level.items() for x in (level, -(-n // BLOCK))]) if per_level else F.create_map().cast("map<int,int>")
    of = lambda level: F.coalesce(F.try_element_at(blocks, level), F.lit(0))
    level, block = F.col("level"), F.col("block")
    texts = texts.withColumn("block", F.pmod(F.xxhash64("n"), of(level)).cast("int"))
    all_of = lambda x: F.when(of(x) > 0, F.sequence(F.lit(0), of(x) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda a, i, b, j, side: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"), F.lit(side).alias("side"))
    # a block meets those of its level, itself included, and of the next one
    own = F.transform(all_of(level), lambda j: place(level, F.least(block, j), level, F.greatest(block, j), 0))
    above = F.transform(all_of(level + 1), lambda j: place(level, block, level + 1, j, 1))
    below = F.transform(all_of(level - 1), lambda j: place(level - 1, j, level, block, 2))
    dealt = texts.select("n", "component", "words", "block", F.explode(F.concat(own, above, below)).alias("at")).select("at.a", "at.i", "at.b", "at.j", "at.side", "block", "n", "component", "words")
    where = ["a", "i", "b", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(place: tuple, rows: list[tuple]) -> pa.RecordBatch:
            level, i, other, j = place
            sizes = np.array([len(r[4]) for r in rows])
            counts = np.array([_counts(r[4]) for r in rows])
            component = np.array([r[3] for r in rows])
            ready: dict[int, _Ready] = {}
            second = np.array([r[0] == 2 or (level == other and r[1] == j) for r in rows])
            first = np.array([r[0] == 1 or (level == other and r[1] == i) for r in rows])
            a, b = [], []  # a forest: texts that are joined already aren't compared
            for x in np.flatnonzero(first).tolist():
                most = (np.maximum(sizes, sizes[x]) * (1 - least) + 1e-9).astype(int)
                fits = second & (component != component[x]) & (np.abs(sizes - sizes[x]) <= most)
                if level == other and i == j:
                    fits[: x + 1] = False
                near = np.flatnonzero(fits)
                less = np.minimum(counts[near], counts[x]).sum(axis=1, dtype=np.int64)
                more = np.maximum(sizes[near], sizes[x])
                # words cut off at 255 in a cell may be common, too
                beyond = int(sizes[x] - counts[x].sum(dtype=np.int64))
                for y in near[less + beyond >= more - most[near]].tolist():
                    if component[x] == component[y]:
                        continue
                    for k in (x, y):
                        if k not in ready:
                            ready[k] = _Ready(rows[k][4])
                    if _similar(ready[x], ready[y], least):
                        a.append(max(rows[x][2], rows[y][2]))
                        b.append(min(rows[x][2], rows[y][2]))
                        component[component == component[y]] = component[x]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        place, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for k, packed_words in enumerate(batch.column(8)):
                here = tuple(columns[c][k] for c in range(4))
                if here != place:
                    if rows:
                        yield links(place, rows)
                    place, rows = here, []
                rows.append((columns[4][k], columns[5][k], columns[6][k], columns[7][k], _opened(packed_words)))
        if rows:
            yield links(place, rows)

    return dealt.repartition(*where).sortWithinPartitions(*where, "n").mapInArrow(run, "a long, b long")


def _rare_words(texts: DataFrame, least: float, pairs: bool = False) -> DataFrame:
    """n, level, tokens of written texts (n, words, component): see rarest() and _levels(). What words are rare is read from a table of SLOTS counts, and tokens of one component alone are left out.
    pairs: also each two of those of which similar texts share two."""
    spark = texts.sparkSession
    none = np.iinfo(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, first, last = np.zeros(SLOTS, np.int64), np.full(SLOTS, none.max), np.full(SLOTS, none.min)
        for batch in batches:
            for x, component in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                slots = _slots(np.unique(_opened(x)))
                often += np.bincount(slots, minlength=SLOTS)
                first[slots] = np.minimum(first[slots], component)
                last[slots] = np.maximum(last[slots], component)
        at = np.flatnonzero(often)
        ends = pa.array(np.searchsorted(at, np.arange(0, SLOTS + 1, SLOTS // PARTS)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at, often[at], first[at], last[at])]], names=["part", "slot", "n", "first", "last"])

    def add_up(rows: pa.Table) -> pa.Table:
        slot, n, first, last = (rows[c].combine_chunks().flatten().to_numpy() for c in ("slot", "n", "first", "last"))
        at, of = np.unique(slot, return_inverse=True)
        total, least_, most = np.zeros(len(at), np.int64), np.full(len(at), none.max), np.full(len(at), none.min)
        np.add.at(total, of, n)
        np.minimum.at(least_, of, first)
        np.maximum.at(most, of, last)
        return pa.table({"slot": [at.tolist()], "n": [total.tolist()], "met": [(least_ < most).tolist()]}, schema=pa.schema({"slot": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "met": pa.list_(pa.bool_())}))

    # a task adds up several partitions, as most words are in each of them, and sends its table in parts
    tasks = max(1, texts.rdd.getNumPartitions() // FAN_IN)
    counts = texts.select("words", "component").coalesce(tasks).mapInArrow(count, "part long, slot array<long>, n array<long>, first array<long>, last array<long>")
    often, met = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool)
    for at, n, several in counts.groupBy("part").applyInArrow(add_up, "slot array<long>, n array<long>, met array<boolean>").collect():
        often[at], met[at] = n, several
    shared = spark.sparkContext.broadcast((often, met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, met = shared.value
        for part in _slices(batches, 256):
            texts = [_opened(x) for x in part.column(1)]
            found = [rarest(w, often, least, met=met).view(np.int64) for w in texts]
            levels = _levels(np.array([len(w) for w in texts], np.int64), least)
            columns = [part.column(0), pa.array(levels), pa.array(found, pa.list_(pa.int64()))]
            if pairs:
                two = [rarest(w, often, least, 2, met) for w in texts]
                columns.append(pa.array([_twos(x).view(np.int64) for x in two], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["n", "level", "tokens", "pairs"][: len(columns)])

    return texts.select("n", "words").mapInArrow(run, "n long, level long, tokens array<long>" + ", pairs array<long>" * pairs)


def _levels(sizes: np.ndarray, least: float) -> np.ndarray:
    """Similar texts are of one level or of two neighbours."""
    return np.floor(np.log(np.maximum(sizes, 1)) / -np.log(least)).astype(np.int64)


def _places(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (_mixed(tokens.view(np.uint64) ^ _mixed((levels + 2).astype(np.uint64) * _M)) & np.uint64(PLACES - 1)).astype(np.int64)


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts of (n, level, tokens), the row of each, and its level."""
    rows = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False))
    return part.column(2).flatten().to_numpy(), rows, part.column(1).to_numpy()[rows]


def _that_meet(found: DataFrame) -> DataFrame:
    """n, tokens, hot of written (n, level, tokens): without tokens that no other text of their level or the next ones has, and without those that more than RARE texts are known to have; hot are texts that have one of these.

    Tasks count tokens that SEVERAL of their texts have at least, so their sums are lower bounds, and mark the places of all. Tokens that
    are kept for want of counts or by places shared make rows more and change no link.
    """
    spark = found.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def often() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            at = times >= SEVERAL
            return pa.RecordBatch.from_arrays([pa.array(tokens[at]), pa.array(times[at])], names=["token", "times"])

        for part in _slices(batches, 512):
            held.append(_flat(part)[0])
            n += len(held[-1])
            if n >= AT_ONCE:
                yield often()
                held, n = [], 0
        if held:
            yield often()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(PLACES, bool), np.zeros(PLACES, bool)
        for part in _slices(batches, 512):
            tokens, _, levels = _flat(part)
            for near in (-1, 0, 1):
                at, times = np.unique(_places(tokens, levels + near), return_counts=True)
                twice[at] |= once[at] | (times > 1)
                once[at] = True
        if once.any():
            packed_ones = [[x.tobytes() for x in np.split(np.packbits(y), PARTS)] for y in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS)), *[pa.array(x, pa.binary()) for x in packed_ones]], names=["part", "once", "twice"])

    def add_up(rows: pa.Table) -> pa.Table:
        once, twice = np.zeros(PLACES // PARTS // 8, np.uint8), np.zeros(PLACES // PARTS // 8, np.uint8)
        for x, y in zip(rows["once"], rows["twice"], strict=True):
            here = np.frombuffer(x.as_py(), np.uint8)
            twice |= np.frombuffer(y.as_py(), np.uint8) | (once & here)
            once |= here
        return pa.table({"part": rows["part"][:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    # a task adds up several partitions, as in _rare_words()
    few = found.select("n", "level", "tokens").coalesce(max(1, found.rdd.getNumPartitions() // FAN_IN))
    counts = few.mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    hot = np.sort(counts.where(F.col("times") > RARE).select("token").toPandas()["token"].to_numpy(np.int64))
    parts = few.mapInArrow(mark, "part long, once binary, twice binary").groupBy("part").applyInArrow(add_up, "part long, twice binary")
    marked = np.zeros((PARTS, PLACES // PARTS // 8), np.uint8)
    for part, twice in parts.collect():
        marked[part] = np.frombuffer(twice, np.uint8)
    shared = spark.sparkContext.broadcast((hot, marked.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, marked = shared.value
        met = np.unpackbits(marked).view(bool)
        for part in _slices(batches, 512):
            tokens, rows, levels = _flat(part)
            known = np.isin(tokens, hot)
            keep = ~known & met[_places(tokens, levels)]
            per_row = lambda which, n=part.num_rows, rows=rows: np.bincount(rows[which], minlength=n)
            ends = np.cumsum(np.concatenate([[0], per_row(keep)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[keep])), pa.array(per_row(known) > 0)], names=["n", "tokens", "hot"])

    return found.select("n", "level", "tokens").mapInArrow(run, "n long, tokens array<long>, hot boolean")


def _twos(tokens: np.ndarray) -> np.ndarray:
    """A hash of each two of some values, in whatever order they come."""
    x = np.sort(tokens)
    i, j = np.triu_indices(len(x), 1)
    return _mixed(x[i] * _M + x[j])


def _short_members(sketched: DataFrame, least: float) -> DataFrame:
    """n, key of the buckets in which texts of fewer than SHORT_END words meet."""
    found = cut(_rare_words(cut(sketched.where((F.col("size") >= K) & (F.col("size") < SHORT_END)).select("n", "words", F.col("n").alias("component"))), least, pairs=True))
    one = found.select("n", F.explode("tokens").alias("key"))
    hot = one.groupBy("key").count().where(F.col("count") > RARE).select("key")
    with_hot = one.join(hot, "key", "left_semi").select("n").distinct()
    two = found.join(with_hot, "n", "left_semi").select("n", F.explode("pairs").alias("key"))
    return one.join(hot, "key", "left_anti").select("n", "key").unionAll(two)


def _sizes_allow(a: str, b: str, least: float) -> Column:
    return F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= _most(a, b, least)


def _most(a: str, b: str, least: float) -> Column:
    return F.floor(F.greatest(f"{a}.size", f"{b}.size") * F.lit(1 - least) + F.lit(1e-9))


def _words_allow(a: str, b: str, least: float) -> Column:
    without = lambda x, y: sum((F.bit_count(F.get(f"{x}.bits", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{y}.bits", F.lit(i))))) for i in range(BITS)), F.lit(0))
    return (without(a, b) <= _most(a, b, least)) & (without(b, a) <= _most(a, b, least))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__row, id_col, class_id, class_key, kept of each row."""
    workers_can_import(docs.sparkSession)
    sketched = cut(_sketched(docs, id_col, text_col).withColumn("n", F.monotonically_increasing_id()))
    all_rows = cut(sketched.select("row", "id", "digest", "n"))
    # one row for each text that differs, known by the row's number
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n"))
    texts = cut(all_rows.groupBy("digest").agg(best.alias("best")).select("digest", "best.row", "best.id", "best.n"))
    distinct = _having(sketched.select("n", "size", "bits", "keys", "words"), _marked(texts))
    sizes = cut(distinct.select("n", "size", "bits"))
    # members of a bucket are exchanged once, and counted where they are
    in_several = lambda rows: cut(rows.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1").drop("many"))
    members = in_several(distinct.select("n", "size", F.explode("keys").alias("key")))
    # buckets of rare words hold few similar pairs, and are met once the others' classes are known
    short = in_several(_short_members(distinct, least))
    links = known = found = None

    def placed(members: DataFrame, again: bool = True) -> tuple[DataFrame, bool]:
        """The members of the buckets that hold several classes, each with its class and a weight, the number of its links. Whether buckets are small on the whole.

        again: after new links.
        """
        nonlocal found
        ends = links.select(F.col("a").alias("n")).unionAll(links.select(F.col("b").alias("n")))
        if again:
            found = cut(components(links).select(F.col("vertex").alias("n"), "component").join(ends.groupBy("n").agg(F.count("*").alias("weight")), "n"))
        rows = members.join(found, "n", "left").withColumns({"component": F.coalesce("component", "n"), "weight": F.coalesce("weight", F.lit(0))})
        rows = cut(rows)
        release(docs.sparkSession)
        bucket = Window.partitionBy("key")
        several = {"many": F.count("*").over(bucket), "__least": F.min("component").over(bucket), "__most": F.max("component").over(bucket)}
        rows = cut(rows.drop("many").withColumns(several).where("__least < __most").drop("__least", "__most"))
        n, pairs = rows.agg(F.count("*"), F.sum(F.col("many") - 1)).first()
        return rows, (pairs or 0) <= MANY * n

    def wanted(numbers: DataFrame) -> DataFrame:
        return cut(_having(sketched.select("n", "words"), _marked(numbers)))

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that weren't compared yet and that words don't exclude."""
        pairs = pairs.distinct()
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        x, y = (sizes.select(F.col("n").alias(c), F.struct("size", "bits").alias(f"of_{c}")) for c in "ab")
        pairs = cut(pairs.join(x, "a").join(y, "b").where(_words_allow("of_a", "of_b", least)).select("a", "b"))
        release(docs.sparkSession)
        return pairs

    def compare(pairs: DataFrame) -> tuple[int, int]:
        """Verifies fitting pairs and adds to links; how many were compared, and how many are similar."""
        nonlocal links, known
        verified = cut(_verified(pairs, wanted(pairs.select(F.col("a").alias("n")).unionAll(pairs.select(F.col("b").alias("n")))), least))
        good = verified.where("similar").select("a", "b")
        links = good if links is None else links.unionAll(good)
        known = verified.select("a", "b") if known is None else known.unionAll(verified.select("a", "b"))
        return tuple(verified.agg(F.count("*"), F.count_if("similar")).first())

    def compare_in_turn(pairs: DataFrame) -> tuple[int, int]:
        """compare(), first each text with one other, the one that has most pairs, then those that aren't of one class by that."""
        ends = pairs.select(F.col("a").alias("n"), F.col("b").alias("other")).unionAll(pairs.select(F.col("b").alias("n"), F.col("a").alias("other")))
        weights = ends.groupBy(F.col("n").alias("other")).agg(F.count("*").alias("weight"))
        best = ends.join(weights, "other").groupBy("n").agg(F.max(F.struct("weight", F.xxhash64("other").alias("hash"), "other")).alias("best"))
        first = cut(best.select(F.greatest("n", "best.other").alias("a"), F.least("n", "best.other").alias("b")).distinct())
        rest = cut(pairs.join(first, ["a", "b"], "left_anti"))
        compared, similar_ones = compare(first)
        if rest.isEmpty():
            return compared, similar_ones
        release(docs.sparkSession)
        class_of = components(links)
        for c in "ab":
            rest = rest.join(class_of.select(F.col("vertex").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
        more, similar_too = compare(cut(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")))
        return compared + more, similar_ones + similar_too

    del distinct
    # at first each text is a class, and weighs as many buckets as it is in
    rows, small = members.withColumns({"weight": F.count("*").over(Window.partitionBy("n")), "component": F.col("n")}), False
    while not small:
        release(docs.sparkSession)
        # the same text in all its buckets as far as can be, so that pairs meet again
        first = F.max(F.struct("weight", F.xxhash64("n").alias("hash"), "n", "size", "component")).over(Window.partitionBy("key"))
        met = rows.select(F.struct("n", "size", "component").alias("m"), first.alias("f")).where((F.col("m.component") != F.col("f.component")) & _sizes_allow("m", "f", least))
        compared, similar_ones = compare_in_turn(fitting(met.select(F.greatest("m.n", "f.n").alias("a"), F.least("m.n", "f.n").alias("b"))))
        del met, first
        release(docs.sparkSession)
        if similar_ones * 10 <= compared and "many" in rows.columns:
            break  # the few new links only make a few pairs more that are compared
        rows, small = placed(members)
    release(docs.sparkSession)
    short_rows = placed(short, again=False)[0]
    rows = rows.drop("size").unionByName(short_rows).select("key", "n", "component", "many")
    few = cut(rows.where(F.col("many") <= MANY).join(sizes, "n"))
    # texts of large buckets meet by their rarest words alone, once, and not in each bucket again
    large = cut(rows.where(F.col("many") > MANY).select("n", "component").dropDuplicates(["n"]).join(sizes, "n"))
    del short_rows, rows

    def met_by(rows: DataFrame, *on: str) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
        met = x.join(y, same).where((F.col("x.n") > F.col("y.n")) & (F.col("x.component") != F.col("y.component")))
        return met.where(_sizes_allow("x", "y", least) & _words_allow("x", "y", least)).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"))

    held = wanted(large.select("n"))
    release(docs.sparkSession)
    that_meet = cut(_that_meet(cut(_rare_words(held.join(large.select("n", "component"), "n"), least))))
    tokens = cut(that_meet.select("n", F.explode("tokens").alias("token")))
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    rare = tokens.join(often.where(F.col("often") <= RARE).select("token"), "token")
    compare(fitting(met_by(few, "key").unionAll(met_by(large.join(rare, "n"), "token"))))
    release(docs.sparkSession)
    # and those with words that are many texts' rarest ones in blocks, as each pair of them shares many
    hot = tokens.join(often.where(F.col("often") > RARE).select("token"), "token", "left_semi").select("n")
    hot = hot.unionAll(that_meet.where("hot").select("n")).distinct()
    links = links.unionAll(cut(_similar_in_blocks(large.select("n", "component", "size").join(hot, "n").join(held, "n"), least)))
    del few, large, held, that_meet, tokens, often, rare, hot, sketched, members, short
    joined = components(links)
    release(docs.sparkSession)
    of_text = texts.join(joined.select(F.col("vertex").alias("n"), "component"), "n", "left").withColumn("component", F.coalesce("component", "n"))
    best = of_text.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"), F.min("digest").alias("class_key"))
    by_text = of_text.select("digest", "component").join(best, "component")
    out = all_rows.select("row", "id", "digest").join(by_text, "digest")
    return out.select(F.col("row").alias("__row"), F.col("id").alias(id_col), F.col("best.id").alias("class_id"), F.lower(F.hex("class_key")).alias("class_key"), (F.col("row") == F.col("best.row")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each class."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").select("__row")
    rows = docs.withColumn("__row", _row(id_col, text_col)).join(kept, "__row", "left_semi")
    return rows.dropDuplicates(["__row"]).drop("__row")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_key, kept."""
    return near_duplicates(docs).drop("__row")
