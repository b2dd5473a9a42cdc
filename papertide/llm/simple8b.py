"""Simple-8b: 64-bit words whose four high bits select how many ids share the other sixty.

A block of ids is one byte string: a header, the lengths of its documents, the place of the first id of
every STRIDE-th word, the words, and the escapes. An id of more than 60 bits stands in the escapes; its
word says where. Packing and unpacking work on whole arrays; only the walk from word to word is a loop.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the code: ids of a word and bits of each, by selector from 1.
MODES = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
STRIDE = 512
HEADER = struct.Struct("<4sIQII")
MAGIC = b"S8B1"

_COUNTS = np.array([0, *(n for n, _ in MODES), 1], np.int64)
_POWERS = 1 << np.arange(60, dtype=np.uint64)
#: Bits of the numbers below 65536.
_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if int(ids.max()) < len(_BITS):
        return _BITS[ids]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.uint8) + (ids >> np.uint64(60) > 0)


def _windows(bits: np.ndarray) -> np.ndarray:
    """The selector with most ids that fit, for a word that begins at each id."""
    n = len(bits)
    best = np.where(bits <= 60, len(MODES), ESCAPE).astype(np.uint8)
    least, size, top = int(bits.min()), 1, np.concatenate([bits, np.zeros(64, bits.dtype)])
    for selector in range(len(MODES) - 1, 0, -1):
        count, width = MODES[selector - 1]
        if width < least:
            break
        while size < count:  # top: the most bits among the next `size` ids
            step = min(size, count - size)
            top = np.maximum(top[: len(top) - step], top[step:])
            size += step
        best[top[:n] <= width] = selector
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, places of the first id of every STRIDE-th word, escapes."""
    ids = np.ascontiguousarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    best = _windows(_bits(ids))
    steps, starts, i, n = _COUNTS[best].tolist(), [], 0, len(ids)
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for selector, (count, width) in enumerate(MODES, 1):
        at = np.flatnonzero(selectors == selector)
        for k in range(count if len(at) else 0):
            words[at] |= padded[starts[at] + k] << np.uint64(k * width)
    at = np.flatnonzero(selectors == ESCAPE)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    return words, starts[::STRIDE].astype(np.uint64), ids[starts[at]]


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    selectors = (words >> np.uint64(60)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(_COUNTS[selectors])])
    out = np.zeros(int(starts[-1]) + 1, np.uint64)
    for selector, (count, width) in enumerate(MODES, 1):
        at = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(at) else 0):
            out[starts[at] + k] = (words[at] >> np.uint64(k * width)) & mask
    at = np.flatnonzero(selectors == ESCAPE)
    out[starts[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def write_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """Of documents that lie one after the other; lengths: their ids."""
    words, places, escapes = pack(ids)
    return b"".join([HEADER.pack(MAGIC, len(lengths), len(ids), len(words), len(escapes)), lengths.astype("<u4").tobytes(), places.astype("<u8").tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])


def _parts(block: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    magic, docs, n, n_words, n_escapes = HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at, out = HEADER.size, []
    for kind, count in (("<u4", docs), ("<u8", -(-n_words // STRIDE)), ("<u8", n_words), ("<u8", n_escapes)):
        out.append(np.frombuffer(block, kind, count, at))
        at += out[-1].nbytes
    return n, *out


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """ids, lengths."""
    n, lengths, _, words, escapes = _parts(block)
    return unpack(words, n, escapes), lengths


def read_ids(block: bytes, first: int, last: int) -> np.ndarray:
    """The ids from first to last, the latter not included; decodes only the words that the places lead to."""
    n, _, places, words, escapes = _parts(block)
    last = min(last, n)
    a = max(0, int(np.searchsorted(places, first, side="right")) - 1)
    b = int(np.searchsorted(places, last, side="left"))
    if first >= last:
        return np.zeros(0, np.uint64)
    end = int(places[b]) if b < len(places) else n
    return unpack(words[a * STRIDE : b * STRIDE], end - int(places[a]), escapes)[first - int(places[a]) : last - int(places[a])]
