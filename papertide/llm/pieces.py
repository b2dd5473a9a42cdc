"""Cutting texts at places that no match of the pre-tokenising pattern crosses.

Every match of the pattern either starts with white space or holds none, and only its last branch
looks ahead, at what follows a run of white space. So a cut between a character that is not white
space and one that is never changes a match, on either side; nor does one between a letter and a stop,
as no branch holds both. Pieces between such cuts can be encoded
one by one; equal pieces have equal ids, so each worker encodes a piece once and keeps its ids.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa


class _Known(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers.

    When full, it sets its pieces aside; those asked for again come back, the others go with the next.
    """

    def __init__(self, encode: Callable[[str], bytes], prefix: str, most: int, longest: int):
        super().__init__()
        self.encode, self.prefix, self.most, self.longest = encode, prefix, most, longest
        self.aside: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.aside.get(piece)
        if ids is None:
            ids = self.encode(self.prefix + piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.aside = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


def _among(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


_CUT, _SPACES = _among(*range(9, 14), 32), _among(*range(9, 14), *range(28, 33))
_STOPS, _LETTERS = _among(*b".,;:!?"), _among(*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _ends_in_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (3, 2, 1))
    general = (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    others = ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | general | others


def cuts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that lie one after the other in UTF-8; texts: the place of each and the end."""
    if not texts[-1]:
        return np.zeros(0, np.int64)
    data = data[: texts[-1]]
    at = np.flatnonzero((_CUT[data[1:]] & ~_SPACES[data[:-1]]) | (_STOPS[data[1:]] & _LETTERS[data[:-1]])) + 1
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    wide = wide[_ends_in_wide_space(data, at[wide])]
    begins = np.zeros(len(data), bool)
    begins[at] = True
    begins[at[wide]] = False
    begins[texts[:-1][np.diff(texts) > 0]] = True
    return np.flatnonzero(begins)


class PieceTable:
    """Encodes many texts at once by their pieces, whose ids are kept in a hash table of arrays.

    Pieces of up to 15 bytes are their own keys, so a hit is exact; longer ones, and those met for the first time,
    go to encode(piece), which gives the ids of one piece. matches: the pattern's matches in a piece, or None if
    it must be encoded whole; with it, a piece of several matches is put together from their ids.
    The table starts anew when `most` pieces are kept, so memory doesn't grow with the texts.
    """

    PAD, CHUNK = 16, 1 << 18

    def __init__(self, encode: Callable[[str], list[int]], matches: Callable[[str], list[str] | None] | None = None, most: int = 3 << 19):
        self.library, self.matches, self.most = encode, matches, max(most, self.CHUNK)
        self.parts = _Known(lambda x: packed(encode(x)), "", most >> 4, 96)
        self.bits = self.most.bit_length()  # at most three quarters of the slots are used
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)  # no key has a zero in high
        self.start, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids, self.end, self.used = np.zeros(1 << 16, np.uint32), 0, 0

    def encode(self, piece: str) -> bytes:
        found = self.matches(piece) if self.matches else None
        if found is None or len(found) == 1:
            return packed(self.library(piece))
        return b"".join(map(self.parts.__getitem__, found))  # a match is one match on its own, too

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        at = self._slots(low, high)
        out = np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        while len(left):
            h = self.high[at]
            same = (h == high[left]) & (self.low[at] == low[left])
            out[left[same]] = at[same]
            on = ~same & (h != 0)
            left, at = left[on], (at[on] + 1) & (len(self.high) - 1)
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, found: list[bytes]) -> None:
        """Keys that differ and aren't kept yet."""
        counts = np.array([len(x) // 4 for x in found], np.int64)
        new = np.frombuffer(b"".join(found), np.uint32)
        while self.end + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.end : self.end + len(new)] = new
        starts = self.end + np.cumsum(counts) - counts
        self.end, self.used = self.end + len(new), self.used + len(found)
        at, left = self._slots(low, high), np.arange(len(low))
        while len(left):
            free = self.high[at] == 0
            k, slot = left[free], at[free]
            self.low[slot], self.high[slot], self.start[slot], self.count[slot] = low[k], high[k], starts[k], counts[k]
            lost = (self.high[at] != high[left]) | (self.low[at] != low[left])  # of several with one slot the last has it
            left, at = left[lost], (at[lost] + 1) & (len(self.high) - 1)

    def __call__(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's."""
        column = column.cast(pa.large_string()).fill_null("")
        texts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        size = int(texts[-1] - texts[0])
        raw = column.buffers()[2][int(texts[0]) : int(texts[-1])].to_pybytes() if size else b""
        data, texts = np.frombuffer(raw + bytes(self.PAD), np.uint8), texts - texts[0]
        starts = cuts(data, texts)
        ends = np.append(starts[1:], size) if len(starts) else starts
        ids, counts = [], np.zeros(len(starts), np.int64)
        for a in range(0, len(starts), self.CHUNK):
            ids.append(self._chunk(raw, data, starts[a : a + self.CHUNK], ends[a : a + self.CHUNK], counts[a : a + self.CHUNK]))
        before = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.diff(before[np.searchsorted(starts, texts)])

    def _chunk(self, raw: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.used + len(starts) > self.most:
            self._clear()
        lengths = ends - starts
        short = np.flatnonzero(lengths < 16)
        base = int(starts[0])
        here = data[base : int(ends[-1]) + self.PAD]
        words = np.ndarray((len(here) - 7,), "<u8", np.ascontiguousarray(here), strides=(1,))
        n, at = lengths[short], starts[short] - base
        low = words[at] & _MASKS[np.minimum(n, 8)]
        high = (words[at + 8] & _MASKS[np.maximum(n - 8, 0)]) | (n.astype(np.uint64) << np.uint64(56))
        slots = self._find(low, high)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            first: dict[bytes, int] = {}
            for i, a, b in zip(missing.tolist(), starts[short[missing]].tolist(), ends[short[missing]].tolist(), strict=True):
                first.setdefault(raw[a:b], i)
            new = np.fromiter(first.values(), np.int64, len(first))
            self._add(low[new], high[new], [self.encode(x.decode()) for x in first])
            slots[missing] = self._find(low[missing], high[missing])
        begin = np.zeros(len(starts), np.int64)
        begin[short], counts[short] = self.start[slots], self.count[slots]
        others = [(i, np.frombuffer(self.encode(raw[starts[i] : ends[i]].decode()), np.uint32)) for i in np.flatnonzero(lengths >= 16).tolist()]
        for i, x in others:
            counts[i] = len(x)
        before = np.cumsum(counts) - counts
        at = np.repeat(begin - before, counts) + np.arange(int(counts.sum()))
        out = self.ids[np.minimum(at, max(0, len(self.ids) - 1))]
        for i, x in others:
            out[before[i] : before[i] + len(x)] = x
        return out


#: The first n of eight bytes.
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
