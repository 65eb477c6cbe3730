"""Vectorised text kernels over Arrow string columns: no Python object per word.

Words are hashed straight from the UTF-8 buffer: a prefix sum of
``byte * R**position`` gives each word's polynomial value modulo 2**64, which a
finaliser mixes together with the word's length. Polynomials modulo 2**64 are
weak for runs of a thousand bytes and more (some collide whatever R is), so
words over LONG_WORD bytes are hashed by XXH3 instead.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 17
_LIBC = ctypes.CDLL(None)
LONG_WORD = 256
_R = 0x9E3779B97F4A7C15
_INVERSE = pow(_R, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

_bytes = np.arange(256)
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
UPPER_BYTE = (_bytes >= 65) & (_bytes <= 90)
LETTER_BYTE = UPPER_BYTE | ((_bytes >= 97) & (_bytes <= 122))
DIGIT_BYTE = (_bytes >= 48) & (_bytes <= 57)
SPACE_BYTE = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
#: ``[^\x20\x09-\x0D]+``
SPACED = ~SPACE_BYTE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = LETTER_BYTE | DIGIT_BYTE | (_bytes >= 128)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SEGMENT + 1)
        made = []
        for base in (_R, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * SEGMENT:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (offsets, bytes); a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def segments(offsets: np.ndarray, data: np.ndarray, keep: np.ndarray):
    """Spans of the buffer of about SEGMENT bytes that cut no word; a longer word makes a longer span."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        if hi < n:
            at = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            if at > lo:
                hi = at
            else:
                stop = int(offsets[np.searchsorted(offsets, lo, side="right")])
                if hi < stop:
                    cut = np.flatnonzero(~keep[data[lo:hi]])
                    if len(cut):
                        hi = lo + int(cut[-1]) + 1
                    else:
                        after = np.flatnonzero(~keep[data[hi:stop]])
                        hi = hi + int(after[0]) if len(after) else stop
                else:
                    hi = stop
        yield lo, hi
        lo = hi


def words(offsets: np.ndarray, data: np.ndarray, keep: np.ndarray, cuts=None):
    """Maximal runs of kept bytes, A-Z lower-cased, never across texts.

    → text number, start and end byte, hash: one entry per word, in order.
    cuts(piece) may give more positions inside a piece at which words end.
    """
    docs, starts, ends, hashes = [], [], [], []
    for lo, hi in segments(offsets, data, keep):
        piece = data[lo:hi]
        kept = keep[piece]
        edge = np.zeros(hi - lo + 1, bool)
        a, b = np.searchsorted(offsets, [lo, hi])
        edge[offsets[a:b] - lo] = True
        if cuts is not None:
            edge[:-1] |= cuts(piece)
        first = kept.copy()
        first[1:] &= ~kept[:-1] | edge[1:-1]
        last = kept.copy()
        last[:-1] &= ~kept[1:] | edge[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        pw, inv = powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(LOWER[piece] * pw[: hi - lo], out=total[1:])
        h = (total[e] - total[s]) * inv[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
        starts.append(s + lo)
        ends.append(e + lo)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    start = np.concatenate(starts)
    docs = np.searchsorted(offsets, start, side="right") - 1
    end, h = np.concatenate(ends), np.concatenate(hashes)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(LOWER[data[start[i] : end[i]]].tobytes())
    return docs, start, end, h


def slices(column: pa.Array, most: int):
    """(first text, texts) of runs of whole texts of at most so many bytes; a longer text is a run by itself."""
    offsets, _ = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi - lo
        lo = hi


def runs(batches, column: int, most: int = 1 << 20):
    """Batches cut into runs of rows whose texts take at most so many bytes, which bounds what is held beside them.

    At the end what the worker has freed goes back to the system: workers stay
    for later tasks, and share the executor's memory with its JVM.
    """
    try:
        for batch in batches:
            for at, n in slices(batch.column(column), most):
                yield batch.slice(at, n)
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(_LIBC, "malloc_trim"):
            _LIBC.malloc_trim(0)


def counts_per_text(docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, minlength=n)[:n] if len(docs) else np.zeros(n, np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for every (start, length), concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(begin - starts, lengths)
